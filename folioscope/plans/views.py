"""The driver's tables seen as the operators' inputs, and the same views as SQL for the oracle.

Flags that the driver's tables lack are arithmetic on their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.storage import dealt, shared_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


#: Metric name -> predicate over a line item, in SQL that both engines read.
RATES = {
    "precision": "l_returnflag = 'N'",
    "recall": "l_discount <= 0.05",
    "split_rate": "l_quantity > 40",
    "merge_rate": "l_quantity < 8",
    "false_rate": "l_returnflag = 'R'",
    "missing_rate": "l_tax > 0.06",
    "spread_missing_rate": "l_tax > 0.06 and l_linenumber > 4",
}
#: The comparability axes of a report, by column of ``reports``.
AXES = ("geometry_detector_version", "iou_threshold")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: a report of an issue, with counts per metric.

    Line items are summed by order before they meet the orders; the small dimensions are joined last.
    """
    item = table(spark, sf_dir, "lineitem")
    rows = item.count()
    lines = dealt(item, rows, "l_orderkey").groupBy("l_orderkey").agg(
        F.count("*").alias("den"), F.min("l_shipdate").alias("first_ship"), *[F.count_if(F.expr(p)).alias(m) for m, p in RATES.items()]
    )
    places = (
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return (
        dealt(table(spark, sf_dir, "orders"), rows, "o_orderkey")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(places, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("report_id"), F.col("o_orderkey").alias("run_seq"),
            F.col("r_name").alias("publisher"), F.col("n_name").alias("title_group"), F.col("c_mktsegment").alias("series"), F.col("o_custkey").alias("issue"),
            day(F.col("o_orderdate")).alias("measured"), day(F.col("first_ship")).alias("event"),
            F.col("o_orderpriority").alias("geometry_detector_version"), F.col("o_orderstatus").alias("iou_threshold"),
            "o_totalprice", "den", *RATES,
        )
    )


REPORTS = """
reports as (
  select o_orderkey report_id, o_orderkey run_seq, r_name publisher, n_name title_group, c_mktsegment series, o_custkey issue,
         strftime(o_orderdate, '%%Y-%%m-%%d') measured, strftime(min(l_shipdate), '%%Y-%%m-%%d') event,
         o_orderpriority geometry_detector_version, o_orderstatus iou_threshold, o_totalprice, count(*) den, %s
  from orders join lineitem on o_orderkey = l_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  group by all),
keyed as (select *, 'cmp_' || substr(sha256('geometry_detector_version=' || geometry_detector_version || '|iou_threshold=' || iou_threshold), 1, 12) comparability_key from reports)
""" % ", ".join(f"count(*) filter (where {p}) \"{m}\"" for m, p in RATES.items())

POINTS = REPORTS + """,
points as (select report_id, run_seq, publisher, title_group, series, issue, measured, event, geometry_detector_version, iou_threshold, comparability_key, den,
                  unnest([%s]) metric, unnest([%s]) num from keyed)
""" % (", ".join(f"'{m}'" for m in RATES if m != "spread_missing_rate"), ", ".join(f'"{m}"' for m in RATES if m != "spread_missing_rate"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: an enriched artifact of a dataset (the source)."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), "quality", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("summary_length"))
    return docs.join(labels, F.col("doc_id") == F.col("label_id"), "left").select(
        F.col("source").alias("dataset"), F.col("doc_id").alias("artifact_id"), F.coalesce("summary_length", F.lit(0)).cast("long").alias("summary_length"),
        (F.col("doc_id") % 11 != 0).alias("has_tags"), (F.col("doc_id") % 7 != 0).alias("has_characters"),
        (F.coalesce("summary_length", F.lit(0)) % 3 != 0).alias("has_dialogue"),
        F.col("label_id").isNotNull().alias("reviewed"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("approved"), F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("locked"),
        F.when(F.col("doc_id") % 13 == 0, "partial").otherwise("complete").alias("status"),
        F.when(F.col("doc_id") % 17 != 0, F.col("doc_id") % 40).cast("int").alias("page"),
    )


ARTIFACTS = """
artifacts as (
  select source dataset, d.doc_id artifact_id, cast(coalesce(length(text), 0) as bigint) summary_length,
         d.doc_id % 11 <> 0 has_tags, d.doc_id % 7 <> 0 has_characters, coalesce(length(text), 0) % 3 <> 0 has_dialogue,
         l.doc_id is not null reviewed, coalesce(quality = 1, false) approved, coalesce(toxic = 0, false) locked,
         case when d.doc_id % 13 = 0 then 'partial' else 'complete' end status,
         cast(case when d.doc_id % 17 <> 0 then d.doc_id % 40 end as integer) page
  from documents d left join labels l on d.doc_id = l.doc_id)
"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn of a conversation: an artifact that a packet refers to."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("dataset"), F.col("conv_id").alias("packet_id"), (F.col("conv_id") * 7 + F.col("turn")).alias("artifact_id"),
        (F.col("conv_id") % 5 != 0).alias("has_confidence"), (F.col("conv_id") % 7 != 0).alias("has_matched"), (F.col("conv_id") % 3 != 0).alias("has_scope"),
    )


PACKETS = """
packet_refs as (
  select 'src' || (conv_id % 20) dataset, conv_id packet_id, conv_id * 7 + turn artifact_id,
         conv_id % 5 <> 0 has_confidence, conv_id % 7 <> 0 has_matched, conv_id % 3 <> 0 has_scope
  from conversations)
"""


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Generated and approved boxes of a page (an order): eighths of a page side, shifted by line number and quantity.

    The lines are summed and stored once; both sides, however often they are read, are made of that.
    """
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"), "l_quantity", "l_returnflag", "l_linestatus")
    line = dealt(item, item.count(), "l_orderkey", "n").groupBy("l_orderkey", "n").agg(F.max("l_quantity").cast("long").alias("q"), F.max("l_returnflag").alias("l_returnflag"), F.max("l_linestatus").alias("l_linestatus"))
    line = shared_table(line, "lines")
    review, scope = (F.col("l_orderkey") % 200).alias("review_id"), F.col("l_orderkey").alias("page_scope")
    stratum = F.when(F.col("l_orderkey") % 9 == 0, "spread").otherwise("page").alias("stratum")
    x, y = (F.col("n") - 1) % 2 * 4, F.floor((F.col("n") - 1) / 2) * 2
    eighth = lambda c: (c / 8.0).cast("double")
    generated = line.where("n % 5 <> 4 or q % 2 = 0").select(
        review, scope, stratum, F.col("n").alias("box_id"), F.col("n").alias("ord"), eighth(x + F.when(F.col("q") % 9 == 0, 2).when(F.col("q") % 3 == 0, 1).otherwise(0)).alias("x"), eighth(y).alias("y"), eighth(F.lit(4.0) - F.col("q") % 2).alias("w"), eighth(F.lit(2.0)).alias("h")
    )
    approved = line.where("l_returnflag <> 'R' or q % 4 <> 0").select(
        review, scope, stratum, F.col("n").alias("box_id"), (F.lit(20) - F.col("n") + F.col("q") % 3 * 5).alias("ord"), eighth(x).alias("x"), eighth(y).alias("y"), eighth(F.when(F.col("q") % 7 == 0, 8.0).otherwise(4.0)).alias("w"), eighth(F.when(F.col("q") % 5 == 0, 4.0).otherwise(2.0)).alias("h"),
        ((F.col("l_linestatus") == "F") & (F.col("q") % 10 == 1)).alias("deleted"),
    )
    return generated, approved


BOXES = """
line as (select l_orderkey, cast(l_linenumber as bigint) n, cast(trunc(max(l_quantity)) as bigint) q, max(l_returnflag) l_returnflag, max(l_linestatus) l_linestatus from lineitem group by 1, 2),
generated as (
  select l_orderkey % 200 review_id, l_orderkey page_scope, case when l_orderkey % 9 = 0 then 'spread' else 'page' end stratum, n box_id, n ord,
         ((n - 1) % 2 * 4 + case when q % 9 = 0 then 2 when q % 3 = 0 then 1 else 0 end) / 8.0 x, ((n - 1) // 2 * 2) / 8.0 y, (4.0 - q % 2) / 8.0 w, 2.0 / 8.0 h
  from line where n % 5 <> 4 or q % 2 = 0),
approved as (
  select l_orderkey % 200 review_id, l_orderkey page_scope, case when l_orderkey % 9 = 0 then 'spread' else 'page' end stratum, n box_id, 20 - n + q % 3 * 5 ord,
         ((n - 1) % 2 * 4) / 8.0 x, ((n - 1) // 2 * 2) / 8.0 y, case when q % 7 = 0 then 8.0 else 4.0 end / 8.0 w, case when q % 5 = 0 then 4.0 else 2.0 end / 8.0 h,
         l_linestatus = 'F' and q % 10 = 1 deleted
  from line where l_returnflag <> 'R' or q % 4 <> 0),
pairs as (
  select * from (
    select g.review_id, g.page_scope, g.stratum, g.box_id gen_id, a.box_id app_id, g.ord gen_ord, a.ord app_ord, cast(g.x as double) gx, cast(g.y as double) gy, cast(a.x as double) ax, cast(a.y as double) ay, cast(g.w as double) gw, cast(g.h as double) gh, cast(a.w as double) aw, cast(a.h as double) ah,
           cast(greatest(least(g.x + g.w, a.x + a.w) - greatest(g.x, a.x), 0) * greatest(least(g.y + g.h, a.y + a.h) - greatest(g.y, a.y), 0) as double) inter
    from generated g join approved a on g.review_id = a.review_id and g.page_scope = a.page_scope and g.stratum = a.stratum and not a.deleted)
  where inter / (gw * gh + aw * ah - inter) >= 0.5),
matches as (select *, inter / (gw * gh + aw * ah - inter) iou from pairs)
"""


def field_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated and approved values of a field, whole: a user turn and the turn after it; a part's name and its type.

    ``disposition`` and ``has_origin``/``origin`` are a record's provenance: of a conversation's eighths one is preserved
    and one came by inheritance; what else is generated carries no flag where the review is an old one.
    """
    whole = lambda c: F.coalesce(c, F.lit(""))
    turns = table(spark, sf_dir, "conversations")
    later = turns.select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), F.col("text").alias("reply"))
    talk = turns.where("role = 'user'").join(later, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t"))).select(
        F.col("conv_id").alias("artifact_id"), F.concat(F.lit("dialogue_"), (F.col("turn") % 4).cast("string")).alias("field"), (F.col("conv_id") % 50).alias("review_id"),
        F.when(F.col("conv_id") % 6 != 0, whole(F.col("text"))).otherwise("").alias("generated"), F.when(F.col("conv_id") % 10 == 1, whole(F.col("text"))).when(F.col("conv_id") % 10 == 2, "").otherwise(whole(F.col("reply"))).alias("approved"),
    )
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("artifact_id"), F.lit("title").alias("field"), (F.col("p_partkey") % 50).alias("review_id"), whole(F.col("p_name")).alias("generated"),
        F.when(F.col("p_size") % 3 == 0, whole(F.col("p_name"))).when(F.col("p_size") % 3 == 1, F.concat(whole(F.col("p_name")), F.lit("s"))).otherwise(whole(F.col("p_type"))).alias("approved"),
    )
    rest = F.col("artifact_id") % 8
    old = (F.col("review_id") % 3 == 0) | (F.col("review_id") % 3 == 1) & (F.col("artifact_id") % 2 == 0)
    return talk.unionByName(part).select(
        "*", F.when(rest == 0, "preserved_approved").when((rest != 1) & ~old, "fresh").alias("disposition"), (rest == 1).alias("has_origin"),
        F.when(rest == 1, F.when(F.col("artifact_id") % 3 == 0, "regenerated").otherwise("inherited")).alias("origin"),
    )


#: Letters beyond ASCII and the control characters that stand for them, one for one, where DuckDB counts bytes.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüÁáÀàú"
_CODES = [k for k in range(1, 32) if k not in (9, 10, 11, 12, 13)]
FIELD_PAIRS = f"""
field_values as (
  select a.conv_id artifact_id, 'dialogue_' || (a.turn % 4) field, a.conv_id % 50 review_id, case when a.conv_id % 6 <> 0 then coalesce(a.text, '') else '' end generated,
         case when a.conv_id % 10 = 1 then coalesce(a.text, '') when a.conv_id % 10 = 2 then '' else coalesce(b.text, '') end approved
  from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn - 1 where a.role = 'user'
  union all
  select p_partkey, 'title', p_partkey % 50, coalesce(p_name, ''), case when p_size % 3 = 0 then coalesce(p_name, '') when p_size % 3 = 1 then coalesce(p_name, '') || 's' else coalesce(p_type, '') end from part),
field_pairs as (
  select *, case when artifact_id % 8 = 0 then 'preserved_approved' when artifact_id % 8 <> 1 and not (review_id % 3 = 0 or review_id % 3 = 1 and artifact_id % 2 = 0) then 'fresh' end disposition,
         artifact_id % 8 = 1 has_origin, case when artifact_id % 8 = 1 then case when artifact_id % 3 = 0 then 'regenerated' else 'inherited' end end origin,
         translate(generated, '{_LETTERS}', {' || '.join(f'chr({k})' for k in _CODES[: len(_LETTERS)])}) g1, translate(approved, '{_LETTERS}', {' || '.join(f'chr({k})' for k in _CODES[: len(_LETTERS)])}) a1
  from field_values),
revised as (
  select * exclude (g1, a1), case when greatest(length(generated), length(approved)) > 0 then cast(levenshtein(g1, a1) as double) / greatest(length(generated), length(approved)) else 0.0 end dist,
         case when has_origin then coalesce(origin in ('generated', 'regenerated'), false) else disposition is null or disposition = 'fresh' end fresh from field_pairs),
classed as (
  select *, case when generated = '' and approved = '' then 'abstention' when generated = '' then 'added' when approved = '' then 'removed' when generated = approved then 'accepted_unchanged'
                 when dist <= 0.10 then 'minor_wording_edit' when dist <= 0.35 then 'moderate_rewrite' when dist <= 0.70 then 'major_rewrite' else 'complete_replacement' end category,
         case when generated = '' and approved = '' then null when generated = '' or approved = '' then 1.0 else dist end distance
  from revised)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Daily audit snapshots of an event type: metric averages, and failure counts by kind."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), day(F.col("ts")).alias("day"), "user_id", "value")
    scores = events.groupBy("dataset", "day").agg(
        F.count("*").alias("artifacts"), F.bround(F.lit(100.0) * F.count_if(F.col("user_id") % 3 != 0) / F.count("*"), 0).cast("int").alias("quality_score"),
        F.bround(F.lit(100.0) * F.count_if(F.col("user_id") % 5 == 0) / F.count("*"), 0).cast("int").alias("weak_percent"),
    )
    kinds = F.array(*[F.struct(F.lit(name).alias("failure"), (F.col("user_id") % m == 0).alias("hit")) for name, m in FAILURE_STEPS.items()])
    failures = events.select("dataset", "day", F.inline(kinds)).where("hit").groupBy("dataset", "day", "failure").agg(F.count("*").alias("failures"))
    return scores, failures


#: Failure kind -> users counted as failing are the multiples of this.
FAILURE_STEPS = {"unreviewed": 4, "not_approved": 7, "not_locked": 11, "missing_dialogue": 97}

SNAPSHOTS = """
daily as (select event_type dataset, strftime(ts, '%Y-%m-%d') "day", user_id from events),
scores as (
  select dataset, "day", count(*) artifacts, cast(round_even(100.0 * count(*) filter (where user_id % 3 <> 0) / count(*), 0) as integer) quality_score,
         cast(round_even(100.0 * count(*) filter (where user_id % 5 = 0) / count(*), 0) as integer) weak_percent
  from daily group by all),
failures as (""" + " union all ".join(f"""select dataset, "day", '{n}' failure, count(*) failures from daily where user_id % {m} = 0 group by all""" for n, m in FAILURE_STEPS.items()) + ")"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with an order: an issue, its latest revision and the states of review and audit."""
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")).alias("o"))
    places = (
        table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return latest.join(places, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("r_name").alias("publisher"), F.col("n_name").alias("title_group"), F.col("c_mktsegment").alias("series"), F.col("o_custkey").alias("issue"),
        F.when(F.col("o_custkey") % 19 != 0, F.col("o.o_orderkey")).alias("revision"),
        F.when(F.col("o.o_orderstatus") == "F", "platform_approved").when(F.col("o.o_orderstatus") == "O", "creator_approved").otherwise("draft").alias("state"),
        F.when(F.col("o.o_orderpriority").startswith("1"), "failed").when(F.col("o.o_orderpriority").startswith("2"), "unprocessed").otherwise("audited").alias("audit_state"),
    )


REGISTRY = """
latest as (select o_custkey, max(o_orderkey) k from orders group by 1),
registry as (
  select r_name publisher, n_name title_group, c_mktsegment series, o.o_custkey issue, case when o.o_custkey % 19 <> 0 then o_orderkey end revision,
         case o_orderstatus when 'F' then 'platform_approved' when 'O' then 'creator_approved' else 'draft' end state,
         case when o_orderpriority like '1%' then 'failed' when o_orderpriority like '2%' then 'unprocessed' else 'audited' end audit_state
  from orders o join latest on o_orderkey = k join customer on o.o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
"""


def materials(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference materials of a target (a brand) at four scope levels, and the edges by which one supersedes another."""
    part = table(spark, sf_dir, "part")
    level = F.element_at(F.array(*map(F.lit, ("publisher", "title_group", "series", "issue"))), (F.col("p_size") % 4 + 1).cast("int"))
    records = part.select(
        F.col("p_brand").alias("target_id"), (F.col("p_partkey") % 97).alias("material_id"), level.alias("level"),
        F.when(F.col("p_partkey") % 13 == 0, "retired").when(F.col("p_size") % 5 == 0, "draft").otherwise("publisher_approved").alias("status"),
        F.when(F.col("p_partkey") % 6 == 0, "special").alias("edition_id"), F.col("p_partkey").alias("revision"),
    )
    edges = part.select(
        F.col("p_brand").alias("target_id"), (F.col("p_partkey") % 97).alias("material_id"), level.alias("level"), ((F.col("p_partkey") * 5 + 1) % 101).alias("supersedes_id"),
        F.when(F.col("p_partkey") % 9 == 0, "unbound").otherwise("bound").alias("binding_status"),
    )
    return records, edges


_LEVEL = "['publisher', 'title_group', 'series', 'issue'][p_size % 4 + 1]"
MATERIALS = f"""
materials as (
  select p_brand target_id, p_partkey % 97 material_id, {_LEVEL} "level", case when p_partkey % 13 = 0 then 'retired' when p_size % 5 = 0 then 'draft' else 'publisher_approved' end status,
         case when p_partkey % 6 = 0 then 'special' end edition_id, p_partkey revision from part),
edges as (
  select p_brand target_id, p_partkey % 97 material_id, {_LEVEL} "level", (p_partkey * 5 + 1) % 101 supersedes_id, case when p_partkey % 9 = 0 then 'unbound' else 'bound' end binding_status
  from part)
"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: an attempt to audit a revision (a user) under that day's methodology."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("revision"), F.concat(F.lit("fp_"), F.date_format("ts", "MMdd")).alias("fingerprint"), F.col("event_id").alias("attempt"), day(F.col("ts")).alias("at"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 4 == 0, "failed").otherwise("processed").alias("status"),
        F.when((F.col("event_type") == "error") | (F.col("event_id") % 4 == 0), F.element_at(F.array(*map(F.lit, ("evidence", "publish"))), (F.col("event_id") % 2 + 1).cast("int"))).alias("failure_stage"),
    )


ATTEMPTS = """
attempts as (
  select user_id revision, 'fp_' || strftime(ts, '%m%d') fingerprint, event_id attempt, strftime(ts, '%Y-%m-%d') "at",
         case when event_type = 'error' or event_id % 4 = 0 then 'failed' else 'processed' end status,
         case when event_type = 'error' or event_id % 4 = 0 then ['evidence', 'publish'][event_id % 2 + 1] end failure_stage
  from events)
"""
