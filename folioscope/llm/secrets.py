"""Secret scanning: a trigram inverted index picks the texts in which a rule can match at all, then regexes verify.

Only DataFrame and SQL functions are used here. Positions are counted in code points.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as ops
from re import _parser as regex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import let, running, shared_table, unused, whole_text

#: Strings and options that the analysis of a pattern keeps apart; beyond them it demands less, never more.
MOST_STRINGS, MOST_OPTIONS = 48, 96
#: Rows of equal text are dealt over so many keys, so that a text with many copies does not meet at one.
SALTS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    ``pattern`` is matched leftmost, without overlap; a match counts if group ``group`` is at least
    ``least`` characters long. The trigrams that a text must hold are derived from the pattern.
    """

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules come first; their order breaks ties between spans of equal start.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("hosted_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})", 0, 1),
)
BASE = ("assign", "access", "hex")

#: A Boolean trigram query: one of the options must occur with all its trigrams. An empty option is met by every text.
Query = frozenset[frozenset[str]]
_ANY: Query = frozenset({frozenset()})


def _either(options) -> Query:
    """The options without those that demand all of another one and more; any text if there are too many."""
    options = set(options)
    least = {o for o in options if not any(p < o for p in options)}
    return frozenset(least) if len(least) <= MOST_OPTIONS else _ANY


def _both(a: Query, b: Query) -> Query:
    both = _either(x | y for x in a for y in b) if len(a) * len(b) <= MOST_OPTIONS**2 else _ANY
    return a if both == _ANY else both  # one side alone demands less, which is safe


def _spelled(strings: set[str]) -> Query:
    return _either(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _needs(items) -> tuple[set[str] | None, Query]:
    """Of a parsed sequence: all strings it can match, lower-cased, if they are few (else None), and its query."""
    run, query, whole = {""}, _ANY, True
    for op, argument in items:
        strings, inner = _need(op, argument)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            query, run, whole = _both(_both(query, _spelled(run)), inner if strings is None else _spelled(strings)), {""}, False
    query = _both(query, _spelled(run))
    return (run if whole else None), query


def _need(op, argument) -> tuple[set[str] | None, Query]:
    if op is ops.LITERAL:
        return {chr(argument).lower()}, _ANY
    if op is ops.IN:
        kinds = {kind for kind, _ in argument}
        letters = {chr(x).lower() for kind, x in argument if kind is ops.LITERAL}
        return (letters if kinds == {ops.LITERAL} and len(letters) <= MOST_STRINGS else None), _ANY
    if op is ops.SUBPATTERN:
        return _needs(argument[-1])
    if op is ops.ATOMIC_GROUP:
        return _needs(argument)
    if op is ops.BRANCH:
        parts = [_needs(p) for p in argument[1]]
        strings = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
        return (strings if strings is not None and len(strings) <= MOST_STRINGS else None), _either(o for _, q in parts for o in q)
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        low, high, inner = argument
        strings, query = _needs(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, _ANY
        if low == high == 1:
            return strings, query
        return None, (query if low else _ANY)
    if op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
        return {""}, _ANY
    return None, _ANY


def trigram_query(rule: Rule) -> Query | None:
    """What a text must hold for the rule's pattern to match: an OR of ANDs of lower-case trigrams; None if nothing.

    Read off the parsed pattern: alternatives are options, sequences of few possible strings are spelled
    out, optional parts may be absent, and whatever is repeated or a wide class breaks the string.
    """
    query = _needs(regex.parse(rule.pattern))[1]
    return None if frozenset() in query else query


def dictionary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """All trigrams that some rule's query names."""
    return sorted({t for r in rules for option in trigram_query(r) or () for t in option})


def build_index(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, text_key) for the trigrams of the rules' queries over (text_key, lowered).

    Trigrams are those of the lower-cased text, so one index serves rules of either case.
    """
    wanted = F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in dictionary(rules)])
    return texts.select("text_key", F.explode(F.filter(wanted, lambda t: t.isNotNull())).alias("trigram")).distinct().select("trigram", "text_key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(text_key, rules): which rules' trigram queries a text satisfies, as a bitmask.

    The postings of each option's trigrams are intersected by counting them per text.
    """
    bits = dictionary(rules)
    words = range(0, len(bits), 60)  # one long holds 60 trigrams
    masks = []
    for w in words:
        places = F.create_map(*[x for k, t in enumerate(bits[w : w + 60]) for x in (F.lit(t), F.lit(1 << k).cast("long"))])
        masks.append(F.bit_or(F.coalesce(F.try_element_at(places, F.col("trigram")), F.lit(0).cast("long"))).alias(f"m{w}"))
    found = index.groupBy("text_key").agg(*masks)

    def holds(option: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in words:
            need = sum(1 << k for k, t in enumerate(bits[w : w + 60]) if t in option)
            if need:
                out = out & (F.col(f"m{w}").bitwiseAND(F.lit(need)) == need)
        return out

    mask = F.lit(0)
    for k, rule in enumerate(rules):
        query = trigram_query(rule)
        if query:
            any_option = F.lit(False)
            for option in query:
                any_option = any_option | holds(option)
            mask = mask + F.when(any_option, 1 << k).otherwise(0)
    return found.select("text_key", mask.cast("int").alias("rules")).where("rules <> 0")


def _matches(text: Column, rule: Rule, order: int) -> Column:
    """Spans (start, order, end) of one rule. What a split leaves between the matches gives their places."""
    lengths = lambda array: F.transform(array, lambda m: F.length(m))
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    parts = F.struct(lengths(found).alias("len"), lengths(tested).alias("test"), lengths(F.split(text, rule.pattern, -1)).alias("gap"))

    def spans(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gap"], 1, F.size(x["len"])), x["len"], lambda g, n: g + n)
        ends = F.zip_with(running(steps, F.lit(0), lambda a, n: a + n), steps, lambda a, n: a + n)
        rows = F.arrays_zip(ends.alias("end"), x["len"].alias("len"), x["test"].alias("test"))
        kept = F.filter(rows, lambda r: r["test"] >= rule.least)
        return F.transform(kept, lambda r: F.struct((r["end"] - r["len"]).alias("start"), F.lit(order).alias("kind"), r["end"].alias("end")))

    return let(parts, spans)


_NONE = "array<struct<start:int,kind:int,end:int>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "secrets") -> DataFrame:
    """``docs`` with ``column``, an array of spans (start, kind, end) sorted by start, then by rule.

    ``kind`` is the rule's place in ``rules``; start and end are code points, end exclusive. Rules with
    mandatory trigrams are matched only in the texts that the index yields; a rule without any (long
    hexadecimal runs) scans every text, in full. The texts found by the index (their digests) are a table
    of their own; Spark may send it to the texts if it is small, and moves both sides otherwise.

    A null text is empty and has no span. Rows and other columns are kept as they are, whatever their
    names; one named like ``column`` is replaced. Equal texts share entries of the index, dealt over
    SALTS keys by ``doc_id`` (one key without that column). An empty table gives no rows.
    """
    docs = docs.drop(column)
    own, key, mask = (unused(n, docs) for n in ("_text_key", "_found_key", "_found_rules"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) if "doc_id" in docs.columns else F.lit(0)
    named = F.concat_ws(":", F.md5(whole_text().cast("binary")), salt)
    index = build_index(docs.select(named.alias("text_key"), F.lower(whole_text()).alias("lowered")), rules)
    found = shared_table(candidates(index, rules), "candidates").select(F.col("text_key").alias(key), F.col("rules").alias(mask))
    marked = docs.withColumn(own, named).join(found, F.col(own) == F.col(key), "left")
    text = whole_text()
    spans = []
    for k, rule in enumerate(rules):
        matches = _matches(text, rule, k)
        if trigram_query(rule) is not None:
            matches = F.when(F.coalesce(F.col(mask), F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0, matches).otherwise(F.array().cast(_NONE))
        elif rule.kind == "hex":
            # a text without one long run cannot match; this test is a scan of the whole text
            matches = F.when(text.rlike(f"[0-9a-f]{{{rule.least}}}"), matches).otherwise(F.array().cast(_NONE))
        spans.append(matches)
    return marked.withColumn(column, F.array_sort(F.concat(*spans))).drop(own, key, mask)


def render(spans: Column, rules: tuple[Rule, ...] = RULES, only: tuple[str, ...] | None = None) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    if only is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin([k for k, r in enumerate(rules) if r.kind in only]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


#: Spans replaced in one piece of a text.
PIECE_SPANS = 256


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; spans that overlap become one.

    Rows, columns and nulls stay; ``n_chars``, if there is one, follows the text. A text is cut into pieces of
    PIECE_SPANS spans first, so that the work does not grow with spans times length.
    """
    column = unused("_found_secrets", docs)
    scanned = scan(docs, column=column)
    text = F.col("text")

    def masked(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        rows = F.arrays_zip(F.transform(spans, lambda s: s["start"]).alias("start"), running(ends, F.lit(0), lambda a, x: F.greatest(a, x)).alias("after"))
        heads = F.filter(rows, lambda h: h["start"] >= h["after"])  # spans that begin behind all earlier ones

        def joined(h: Column) -> Column:
            firsts = F.filter(F.sequence(F.lit(1), F.size(h), F.lit(PIECE_SPANS)), lambda i: i <= F.size(h))
            return F.array_join(F.transform(firsts, lambda i: let(F.slice(h, i, PIECE_SPANS), piece)), "")

        def piece(part: Column) -> Column:
            base = F.get(part, F.lit(0))["after"]
            held = F.substring(text, base + 1, F.element_at(part, -1)["start"] - base)
            return let(held, lambda x: F.array_join(F.transform(part, lambda s: F.concat(F.substring(x, s["after"] - base + 1, s["start"] - s["after"]), F.lit(mask))), ""))

        return F.concat(let(heads, joined), F.substring(text, F.array_max(ends) + 1, F.lit(2147483647)))

    out = scanned.withColumn("text", F.when(F.size(column) > 0, let(F.col(column), masked)).otherwise(text)).drop(column)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(text.isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(render(F.col("secrets"), only=BASE), 256).alias("base_sha256"), render(F.col("secrets")).alias("spans"),
    )


def _oracle() -> str:
    """The same spans in SQL: what a split leaves between the matches gives their places."""
    parts = []
    for k, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"select doc_id, {k} k, '{rule.kind}' kind, unnest(list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x))) len, "
            f"unnest(list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda x: length(x))) tested, "
            f"unnest(list_transform(regexp_split_to_array(t, '{pattern}')[:-2], lambda x: length(x))) gap, {rule.least} least, "
            f"unnest(range(len(regexp_extract_all(t, '{pattern}', 0)))) i from d"
        )
    base = ", ".join(f"'{b}'" for b in BASE)
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
m as ({' union all '.join(parts)}),
p as (select *, sum(gap + len) over (partition by doc_id, k order by i) fin from m),
s as (select doc_id, k, kind, cast(fin - len as bigint) start, cast(fin as bigint) fin from p where tested >= least),
a as (select doc_id, count(*) filter (where k = 0) n_assign, count(*) filter (where k = 1) n_access, count(*) filter (where k = 2) n_hex,
             string_agg(kind || ':' || start || ':' || fin, ',' order by start, k) filter (where kind in ({base})) base,
             string_agg(kind || ':' || start || ':' || fin, ',' order by start, k) spans from s group by 1)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join a using (doc_id)
"""


ORACLE_SQL = _oracle()
