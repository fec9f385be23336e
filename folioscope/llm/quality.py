"""Quality rules kept as a ledger: measurements and one failure bit per rule, policies applied afterwards."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import mix64, slices, span_hashes, utf8, word_spans

WINDOW_WORDS = 8
SLICE_BYTES = 2 << 20
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_stutters")

#: Rule name -> the predicate under which a document fails it, over the measurements. The position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbol_ratio": "4 * n_symbols > n_words",
    "bang_ratio": "4 * n_bangs > n_words",
    "stutter_ratio": "10 * n_stutters > 3 * n_words",
    "duplicate_lines": "n_lines >= 4 and 10 * n_dup_lines > 5 * n_lines",
    "short_words": "n_words > 0 and word_chars < 2 * n_words",
    "long_words": "word_chars > 40 * n_words",
}

#: Policy version -> the rules it enforces. Older versions stay, so that old verdicts can be recomputed.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
}
CURRENT = "v1"


def rule_mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of true flags in each row."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def measure(texts: pa.Array) -> pa.StructArray:
    """The measurements of each text; all are counts over the whole text."""
    data, offsets = utf8(texts)
    n = len(offsets) - 1
    starts, ends = word_spans(data, offsets)
    first = np.searchsorted(starts, offsets)  # of each row's words, with the total last
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.subtract.at(inside, ends, 1)
    in_word = np.cumsum(inside[:-1]).astype(bool)

    row_end = np.zeros(len(data) + 1, bool)
    row_end[offsets[1:]] = True
    breaks = data == 0x0A
    line_end = np.flatnonzero(breaks | row_end[1:]) + 1 if len(data) else np.zeros(0, np.int64)
    line_start = np.concatenate([[0], line_end[:-1]]).astype(np.int64) if len(line_end) else line_end
    content_end = line_end - breaks[line_end - 1] if len(line_end) else line_end
    words_before = np.concatenate([[0], np.cumsum(in_word)])
    full = words_before[content_end] > words_before[line_start] if len(line_end) else np.zeros(0, bool)
    line_start, content_end = line_start[full], content_end[full]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    lines = np.bincount(line_row, minlength=n)[:n]
    keys = np.stack([line_row.astype(np.uint64), span_hashes(data, line_start, content_end)], 1) if len(line_start) else np.zeros((0, 2), np.uint64)
    distinct = np.unique(keys, axis=0)[:, 0].astype(np.int64) if len(keys) else np.zeros(0, np.int64)
    repeats = lines - np.bincount(distinct, minlength=n)[:n]

    repeat_words = np.zeros(n, np.int64)
    total = len(starts)
    words = span_hashes(data, starts, ends)
    row = np.repeat(np.arange(n), np.diff(first))
    stutters = np.zeros(total, bool)
    stutters[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    if total >= WINDOW_WORDS:
        wide = total - WINDOW_WORDS + 1
        window = np.zeros(wide, np.uint64)
        for k in range(WINDOW_WORDS):
            window = mix64(window + words[k : k + wide])
        whole = np.flatnonzero(row[:wide] == row[WINDOW_WORDS - 1 :])
        window = mix64(window[whole] + row[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(whole), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(total + 1, np.int64)
        cover[whole[twice]] += 1
        cover[whole[twice] + WINDOW_WORDS] -= 1
        # starts are distinct and so are ends, but one window's end may be another's start: both were added
        repeat_words = _per_row(np.cumsum(cover[:-1]) > 0, first)

    counts = {
        "n_words": np.diff(first),
        "word_chars": _per_row(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_row(_SYMBOL[data], offsets),
        "n_dup_lines": repeats,
        "n_repeat_words": repeat_words,
        "n_lines": lines,
        "n_bangs": _per_row(data == ord("!"), offsets),
        "n_stutters": _per_row(stutters, first),
    }
    return pa.StructArray.from_arrays([pa.array(counts[m].astype(np.int64)) for m in MEASURES], names=list(MEASURES))


def annotate(docs: DataFrame, column: str = "ledger", text: str = "text") -> DataFrame:
    """``docs`` with a struct of measurements and ``failed``, the bitmask of failed rules.

    Every rule is evaluated once for each row, whatever the policies say. A null text counts as
    empty: no words, so it fails few_words. Rows keep their number and all their columns; a column
    named like ``column`` is replaced. Each text is judged by itself and nothing is shuffled.
    """
    docs = docs.drop(column)
    kept = docs.schema.fieldNames()
    at = kept.index(text)
    out = T.StructType([*docs.schema.fields, T.StructField(column, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, measure(batch.column(at))], names=[*kept, column])

    measured = docs.mapInArrow(run, out)
    bits = sum((F.when(_over(rule, column), F.lit(1 << k)).otherwise(0) for k, rule in enumerate(RULES.values())), F.lit(0))
    return measured.withColumn(column, F.col(column).withField("failed", bits.cast("long")))


def _over(rule: str, column: str) -> Column:
    """A rule's predicate, with its names taken from the struct."""
    import re

    return F.expr(re.sub(r"\b(" + "|".join(MEASURES) + r")\b", rf"`{column}`.\1", rule))


def verdict(failed: Column, policy: str = CURRENT) -> Column:
    """Whether a document passes all rules of a policy version."""
    return failed.bitwiseAND(F.lit(rule_mask(POLICIES[policy]))) == 0


def sole_rule(failed: Column, policy: str = CURRENT) -> Column:
    """The one rule for which alone a policy rejects a document: without it the document would stay. Null if there is none."""
    only = failed.bitwiseAND(F.lit(rule_mask(POLICIES[policy])))
    out = F.lit(None).cast("string")
    for k, rule in enumerate(RULES):
        out = F.when(only == 1 << k, rule).otherwise(out)
    return out


def ablations(failed: DataFrame, column: str = "failed", policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """For each policy version and rule: rows the rule fails, and rows only it rejects under that policy.

    Rows are first counted by bitmask, so what is shuffled is one row per distinct mask and task.
    """
    patterns = failed.groupBy(F.col(column).alias("failed")).count()
    rules = [(p, r, rule_mask(rs), 1 << list(RULES).index(r)) for p, rs in policies.items() for r in rs]
    table = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for p, r, m, b in rules])
    each = patterns.select("failed", "count", F.inline(table))
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(F.expr("failed & bit != 0"), F.col("count")).otherwise(0)).alias("failed_rows"),
        F.sum(F.when(F.expr("failed & mask = bit"), F.col("count")).otherwise(0)).alias("rejected_by_it_alone"),
        F.sum(F.when(F.expr("failed & mask != 0"), F.col("count")).otherwise(0)).alias("rejected_rows"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, base verdict, the current policy's verdict of every document, and the rule that alone rejects it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = annotate(docs).select("doc_id", "ledger.*")
    base_failed = ~verdict(F.col("failed"), "base")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & verdict(F.col("failed"))).alias("kept"),
        "n_lines", "n_bangs", "n_stutters", F.col("failed").alias("failed_bits"), sole_rule(F.col("failed")).alias("sole_rule"),
    )


ORACLE_SQL = """
with d as (select doc_id, coalesce(text, '') t, row_number() over () rid from documents),
w as (select rid, unnest(ws) word, unnest(range(1, len(ws) + 1)) i
      from (select rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') ws from d)),
wl as (select *, lag(word) over (partition by rid order by i) earlier from w),
wm as (select rid, count(*) n_words, sum(length(word)) word_chars, count(*) filter (word = earlier) n_stutters
       from wl group by rid),
g as (select rid, i, string_agg(word, ' ') over win s, count(*) over win c from w
      window win as (partition by rid order by i rows between current row and 7 following)),
r as (select rid, i, count(*) over (partition by rid, s) k from g where c = 8),
rw as (select rid, count(distinct j) n_repeat_words
       from (select rid, unnest(range(i, i + 8)) j from r where k > 1) group by rid),
l as (select rid, count(*) n_lines, count(*) - count(distinct line) n_dup_lines
      from (select rid, unnest(string_split(t, chr(10))) line from d)
      where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by rid),
m as (select d.doc_id, coalesce(n_words, 0) n_words, cast(coalesce(word_chars, 0) as bigint) word_chars,
             cast(length(t) - length(regexp_replace(t, '[#*$%%&|<>]', '', 'g')) as bigint) n_symbols,
             coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words,
             coalesce(n_lines, 0) n_lines, cast(length(t) - length(replace(t, '!', '')) as bigint) n_bangs,
             coalesce(n_stutters, 0) n_stutters
      from d left join wm using (rid) left join rw using (rid) left join l using (rid)),
b as (select *, cast(%s as bigint) failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & 3 <> 0 base_failed, failed_bits & %d = 0 kept, n_lines, n_bangs, n_stutters, failed_bits,
       case failed_bits & %d %s end sole_rule
from b
""" % (" + ".join(f"(case when {rule} then {1 << k} else 0 end)" for k, rule in enumerate(RULES.values())), rule_mask(POLICIES[CURRENT]), rule_mask(POLICIES[CURRENT]), " ".join(f"when {1 << k} then '{rule}'" for k, rule in enumerate(RULES)))


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each policy version and rule, over all documents: how many the rule fails, how many it alone rejects, how many are rejected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ablations(annotate(docs).select("ledger.failed"))


_TOLD = ", ".join(f"('{p}', '{r}', {rule_mask(rules)}, {1 << list(RULES).index(r)})" for p, rules in POLICIES.items() for r in rules)
ABLATIONS_SQL = f"""
select policy, rule, count(*) filter (failed_bits & bit <> 0) failed_rows, count(*) filter (failed_bits & mask = bit) rejected_by_it_alone, count(*) filter (failed_bits & mask <> 0) rejected_rows
from ({ORACLE_SQL}) ledger, (values {_TOLD}) told(policy, rule, mask, bit) group by policy, rule
"""
