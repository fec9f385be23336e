"""Queries of the reading and adapting operators: records are made as JSON from the driver's tables and then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.functions import columns as C
from folioscope.operators import benchmarks as B
from folioscope.operators import findings as P
from folioscope.operators import geometry as G
from folioscope.operators import projections as J
from folioscope.operators import registry as R
from folioscope.operators import reports as S
from folioscope.operators import revisions as E
from folioscope.plans import benchmark_plans, geometry_plans, revision_plans
from folioscope.plans import views as V
from folioscope.sources import adapters as A
from folioscope.sources import ingest as I
from folioscope.storage import shared_folder, shared_table

text = lambda c: F.col(c).cast("string")


def _places(spark, d):
    return V.table(spark, d, "customer").join(V.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def _prefix():
    return F.concat_ws("/", F.lit("publishers"), F.col("r_name"), F.lit("title_groups"), F.col("n_name"), F.lit("series"), F.col("c_mktsegment"), F.lit("issues"), text("c_custkey"))


def discovered_issues(spark, d):
    """Customers as issues. Of each, the pointer's path; of those in debt a path whose chain is broken."""
    broken = F.concat_ws("/", F.lit("publishers"), F.col("r_name"), F.lit("issues"), text("c_custkey"))
    paths = _places(spark, d).select(F.concat(F.lit("s3://bucket/"), F.when(F.col("c_acctbal") < 0, broken).otherwise(_prefix()), F.lit("/approved/published.json")).alias("path"))
    return I.discover_issues(paths.union(paths).union(paths.select(F.concat(F.col("path"), F.lit(".bak")))))


def scanned_issues(spark, d):
    """The same pointers as files in a folder: written there, then found by a listing that reads no content, then resolved."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    broken = F.concat_ws("/", F.lit("publishers"), F.col("r_name"), F.lit("issues"), text("c_custkey"))
    place = F.when(F.col("c_acctbal") < 0, broken).otherwise(_prefix())
    pointer = F.to_json(F.struct(F.concat(F.lit("rev_"), text("c_custkey")).alias("revision_id"), F.when(F.col("c_custkey") % 9 != 0, F.concat(F.lit("k/"), text("c_custkey"))).alias("revision_key")))
    documents = _places(spark, d).select(F.concat(place, F.lit("/approved/published.json")).alias("path"), pointer.alias("content"))
    shared_table(I.write_files(I.dealt_files(documents, V.table(spark, d, "customer").count(), "path"), root), "written")
    listed = shared_table(I.listed_files(spark, root).where(F.col("path").endswith(I.POINTER_NAME)).select("path"), "listed")
    contents = I.read_files(I.dealt_files(listed, listed.count(), "path"), root).select(F.regexp_extract("path", r"(publishers/.+)/approved/published.json$", 1).alias("issue_prefix"), "content")
    every = I.judged_pointers(contents).select("issue_prefix", F.when(F.col("reject_reason").isNull(), F.col("revision_key")).alias("revision_key"), "reject_reason")
    # both sides grow with the issues; of paths, whose files are small, Spark would take one for small
    return I.discover_issues(listed).hint("merge").join(every, "issue_prefix")


def identity_conflicts(spark, d):
    """Orders filed under a series other than their customer's."""
    orders = V.table(spark, d, "orders").join(_places(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.select("o_orderkey", _prefix().alias("approved"), F.concat_ws("/", F.lit("publishers"), "r_name", F.lit("title_groups"), "n_name", F.lit("series"), F.when(F.col("o_orderpriority").startswith("1"), "MACHINERY").otherwise(F.col("c_mktsegment"))).alias("reports"))
    return I.identity_conflicts(rows, "approved", "reports").select("o_orderkey")


def resolved_pointers(spark, d):
    """Orders as pointers: open ones lack the revision, pending ones the key."""
    record = F.struct(F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("rev_"), text("o_orderkey"))).alias("revision_id"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("k/"), text("o_orderkey"))).otherwise("").alias("revision_key"))
    pointers = V.table(spark, d, "orders").select(text("o_orderkey").alias("issue_prefix"), F.to_json(record).cast("binary").alias("content"))
    good, bad = I.resolve_pointers(pointers)
    return good.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad)


def snapshot_files(spark, d):
    """Suppliers as issues with a snapshot of three files. By nation: no snapshot, a wrong digest, a file with a wrong digest, a file too few, a file that cannot be decoded."""
    kind = F.col("s_nationkey") % 7
    body = lambda k: F.concat(F.col("s_name"), F.lit(f"#{k}")).cast("binary")
    one = lambda k, name: F.struct(
        F.lit(name).alias("path"), F.when((kind == 4) & F.lit(k == 1), "%%%").otherwise(F.base64(body(k))).alias("content_b64"), F.when((kind == 2) & F.lit(k == 0), "0").otherwise(F.sha2(body(k), 256)).alias("sha256"), F.lit(1).cast("long").alias("size")
    )
    listed = F.array(*[one(k, n) for k, n in enumerate(I.REQUIRED_FILES)])
    rows = V.table(spark, d, "supplier").withColumn("content", F.to_json(F.struct(F.when(kind == 3, F.slice(listed, 1, 2)).otherwise(listed).alias("artifacts"))).cast("binary"))
    rows = rows.withColumn("revision_id", F.concat(F.lit("rev_"), F.when(kind == 1, "wrong").otherwise(F.sha2("content", 256)))).withColumn("revision_key", F.concat(F.lit("k/"), text("s_suppkey")))
    pointers = rows.select(text("s_suppkey").alias("issue_prefix"), "revision_id", "revision_key")
    whole, rejected = I.extract_snapshots(pointers, rows.where(kind != 0).select(F.col("revision_key").alias("key"), "content"))
    return whole.select("issue_prefix", "path", F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("reject_reason")).unionByName(rejected.select("issue_prefix", "path", F.lit(None).cast("string").alias("sha256"), "reject_reason"))


def contract_records(spark, d):
    """Conversations as lists of turns, bare or wrapped; some are no JSON at all."""
    turns = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    wrapped = F.to_json(F.struct(F.col("t").alias("outputs")))
    docs = turns.select("conv_id", F.when(F.col("conv_id") % 7 == 0, "not json").when(F.col("conv_id") % 2 == 0, F.to_json("t")).otherwise(wrapped).alias("content"))
    rows = I.contract_list(docs, "outputs")
    return rows.select("conv_id", F.variant_get("record", "$.turn", "long").alias("turn"), F.variant_get("record", "$.role", "string").alias("role"))


def evidence(spark, d):
    """Suppliers as issues: what could be read of each role, by nation and balance."""
    rows = V.table(spark, d, "supplier").select(text("s_suppkey").alias("issue_prefix"), "s_nationkey", "s_acctbal", "s_name")
    roles = [(r, k) for k, r in enumerate(I.ROLES)]
    each = rows.select("*", F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(k).alias("k")) for r, k in roles])))
    there = (F.col("s_nationkey") + F.col("k")) % 5 != 0
    objects = each.where(there | (F.col("s_acctbal") < 0)).select("issue_prefix", "role", F.when(there, F.concat("s_name", F.lit("/"), "role").cast("binary")).alias("content"), F.when(~there, F.when(F.col("s_nationkey") % 2 == 0, "denied").otherwise("timeout")).alias("error"))
    return I.evidence_manifest(rows.select("issue_prefix"), objects)






def certified_states(spark, d):
    """Orders with the platform's approval where they are finished."""
    orders = V.table(spark, d, "orders")
    approvals = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("review_id"), F.concat(F.lit("platform_"), F.col("o_orderpriority")).alias("state"))
    return A.certified_state(orders.select(F.col("o_orderkey").alias("review_id"), (F.col("o_orderstatus") == "O").alias("creator_approved")), approvals).select("review_id", "certified_state")


def review_identifiers(spark, d):
    """Ids of reviews from their revisions, pages from ranges and panel ids."""
    orders = V.table(spark, d, "orders")
    ids = F.concat(F.lit("page_"), text("o_custkey"), F.lit("_panel_1"))
    ranges = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("24"), F.lit("25"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("x")))
    return orders.select("o_orderkey", C.review_id(F.concat(F.lit("rev_"), F.sha2(text("o_orderkey"), 256))).alias("review_id"), C.page_of(ranges, ids).alias("page"))


def methodology_fingerprints(spark, d):
    """Orders by the fingerprint of the versions that made them."""
    key = C.fingerprint({"algorithm_version": F.col("o_orderpriority"), "report_version": F.col("o_orderstatus"), "evaluation_version": F.lit("1")})
    return V.table(spark, d, "orders").groupBy(key.alias("fingerprint")).agg(F.count("*").alias("runs"))


def written_differences(spark, d):
    """Orders as stored: pending ones are gone, urgent ones were changed."""
    made = V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    kept = made.where("o_orderstatus <> 'P'").withColumn("o_totalprice", F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return S.verify_written(made, kept, "o_orderkey")


def index_details(spark, d):
    """Index entries of reviews with the counts of each field; entries whose report is gone drop out."""
    classed = revision_plans._classed(spark, d)
    details = E.metadata_delta(classed.withColumn("review_id", F.struct("review_id", "field"))).select(F.col("review_id.review_id").alias("report_id"), "review_id.field", "accepted", "edited", "expected").where("report_id % 10 <> 3")
    index = classed.groupBy(F.col("review_id").alias("report_id")).agg(F.count_if(F.col("category") != "abstention").alias("comparable_fields"))
    index = index.select("report_id", "comparable_fields", (F.col("report_id") % 7 != 0).alias("applicable"), F.concat(F.lit("cmp_"), (F.col("report_id") % 2).cast("string")).alias("comparability_key"))
    return P.index_details(index, details)


def _reviews(spark, d):
    """Reviews with the figures of both deltas, their evidence and what was certified."""
    delta = shared_table(G.geometry_delta(*geometry_plans._stored(spark, d)), "delta")
    c = F.col
    total = delta.where("stratum = 'total'").select("review_id", *["precision", "recall", "split_rate", "merge_rate"], c("approved").alias("geo_approved"), c("generated").alias("geo_generated"), c("corrections").alias("geo_corrections"), F.bround(c("false_rate") * c("generated"), 0).cast("long").alias("geo_false"))
    part = lambda s, name: delta.where(c("stratum") == s).select("review_id", F.bround(c("missing_rate") * c("approved"), 0).cast("long").alias(name))
    meta = E.metadata_delta(revision_plans._classed(spark, d)).select("review_id", c("expected").alias("meta_expected"), c("acceptance_rate").alias("meta_acceptance_rate"), c("edit_rate").alias("meta_edit_rate"), c("addition_rate").alias("meta_addition_rate"))
    rows = total.join(part("page", "geo_missing"), "review_id", "left").join(part("spread", "geo_spread_missing"), "review_id", "left").join(meta, "review_id", "left")
    r = c("review_id")
    each = rows.select("review_id", F.inline(F.array(*[F.struct(F.lit(name).alias("role"), F.lit(k).alias("k")) for k, name in enumerate(I.ROLES)])))
    denied = r % 13 == c("k")
    objects = each.where(r % 11 != c("k")).select(c("review_id").alias("issue_prefix"), "role", F.when(~denied, c("role").cast("binary")).alias("content"), F.when(denied, "denied").alias("error"))
    roles = P.roles_of(I.evidence_manifest(rows.select(c("review_id").alias("issue_prefix")), objects)).withColumnRenamed("issue_prefix", "review_id")
    rows = rows.join(roles, "review_id")
    there = c("meta_expected").isNotNull()
    return rows.select(
        "review_id", "roles", F.when(r % 17 == 5, "unsupported review_version").alias("adapter_error"), F.when(r % 4 == 0, "platform_approved").otherwise("creator_approved").alias("certified_state"), (r % 4 != 3).alias("passes_integrity"),
        there.alias("meta_applicable"), F.when(r % 5 != 0, c("meta_expected")).otherwise(0).alias("meta_compared"), F.when(r % 5 == 0, c("meta_expected")).otherwise(0).alias("meta_mismatched"), F.when(~there, "manual_publication").alias("meta_reason"),
        "meta_acceptance_rate", "meta_edit_rate", "meta_addition_rate", (r % 19 != 7).alias("geo_applicable"), F.when(r % 19 == 7, "manual_publication").alias("geo_reason"),
        *[c(n).alias(f"geo_{n}") for n in ("precision", "recall", "split_rate", "merge_rate")], "geo_approved", F.coalesce("geo_missing", F.lit(0)).alias("geo_missing"), F.coalesce("geo_spread_missing", F.lit(0)).alias("geo_spread_missing"), "geo_false",
        F.sha2(r.cast("string"), 256).alias("delta_sha256"), c("geo_corrections").alias("correction_ledger_entries"), F.concat(F.lit("rev_"), text("review_id")).alias("published_revision_id"), F.concat(F.lit("gen_"), text("review_id")).alias("generated_revision_id"),
        F.lit("2024-01-01").alias("event_time"), F.when(r % 4 == 0, "2024-01-02").alias("certified_at"),
    )


def review_findings(spark, d):
    return P.project_findings(_reviews(spark, d))


def delta_summary(spark, d):
    return P.delta_summary(_reviews(spark, d))


def state_comparison(spark, d):
    return P.state_comparison(_reviews(spark, d)).select("review_id", "certified.*", "measured.*")


def report_rows(spark, d):
    reviews = _reviews(spark, d)
    axes = {"task": F.lit("geometry"), "iou_threshold": F.lit("0.5")}
    return P.report_rows(reviews, P.project_findings(reviews), axes, {"task": F.lit("metadata"), "schema": F.when(F.col("review_id") % 2 == 0, "1.1").otherwise("2")})


def materialized_projections(spark, d):
    """Benchmarks of all levels and the registry's roll-up, rebuilt and read back; rows of each that are stored."""
    folder = f"{shared_folder(spark)}/projections-{uuid.uuid4().hex}"
    benchmark = benchmark_plans.benchmark_hierarchy(spark, d)
    registry = R.rollup(V.registry(spark, d))
    status = J.rebuild(spark, folder, {"benchmark": (benchmark, "level", (*B.PLACE, "level", "comparability_key", "metric")), "registry": (registry, "level_bits", (*R.SERIES, "level_bits"))}, "2024-01-01T00:00:00Z")
    sizes = None
    for name, level in (("benchmark", "level"), ("registry", "level_bits")):
        part = spark.read.parquet(f"{folder}/{name}").groupBy(F.col(level).cast("string").alias("level"), "generated_at").agg(F.count("*").alias("rows")).withColumn("projection", F.lit(name))
        sizes = part if sizes is None else sizes.unionByName(part)
    return sizes.join(status, "projection")


QUERIES = [
    discovered_issues, scanned_issues, identity_conflicts, resolved_pointers, snapshot_files, contract_records, evidence,
    certified_states, review_identifiers, methodology_fingerprints, written_differences, index_details, review_findings, delta_summary, state_comparison, report_rows, materialized_projections,
]

_PLACES = "customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
_PREFIX = "'publishers/' || r_name || '/title_groups/' || n_name || '/series/' || c_mktsegment || '/issues/' || c_custkey"
_FILES = ", ".join(f"'{f}'" for f in I.REQUIRED_FILES)
_REVIEWS = f"""gd as ({geometry_plans.ORACLES['geometry_delta']}), md as ({revision_plans.ORACLES['metadata_delta']}),
base as (select t.review_id, t."precision", t.recall, t.split_rate, t.merge_rate, t.approved, t.corrections, cast(round_even(t.false_rate * t.generated, 0) as bigint) f, coalesce(cast(round_even(p.missing_rate * p.approved, 0) as bigint), 0) m, coalesce(cast(round_even(s.missing_rate * s.approved, 0) as bigint), 0) sm,
   expected, acceptance_rate, edit_rate, addition_rate, expected is not null applicable
  from gd t left join gd p on p.review_id = t.review_id and p.stratum = 'page' left join gd s on s.review_id = t.review_id and s.stratum = 'spread' left join md on md.review_id = t.review_id where t.stratum = 'total'),
reviews as (select *, {', '.join(f"case when review_id % 11 = {k} then 'missing' when review_id % 13 = {k} then 'denied' else 'read' end r{k}" for k in range(4))}, review_id % 17 = 5 bad, review_id % 19 <> 7 geo, case when review_id % 5 <> 0 then expected else 0 end compared, case when review_id % 5 = 0 then expected else 0 end mismatched from base)"""
_FINDINGS = f"""{_REVIEWS}, lacking as (select review_id, array_to_string(list_filter([case when r0 <> 'read' then 'approved_pointer' end, case when r1 <> 'read' then 'processing_snapshot' end, case when r2 <> 'read' then 'review_report' end], lambda x: x is not null), ', ') l from reviews),
findings as (
 select review_id, 'evidence.loaded' code, case when l = '' then 'PASS' else 'FAIL' end severity, ((r0 = 'read')::int + (r1 = 'read')::int + (r2 = 'read')::int + (r3 = 'read')::int) || '/4 objects read' || case when l <> '' then '; required not read: ' || l else '' end detail from reviews join lacking using (review_id)
 union all select review_id, 'platform.approval', case r3 when 'read' then 'PASS' when 'missing' then 'WARNING' else 'FAIL' end, r3 from reviews
 union all select review_id, 'publisher.mutation', 'PASS', 'read only' from reviews
 union all select review_id, 'contract.adapted', case when bad then 'FAIL' else 'PASS' end, case when bad then 'unsupported review_version' else 'supported versions' end from reviews
 union all select review_id, 'publisher.certified_state', case when review_id % 4 <> 3 then 'INFO' else 'WARNING' end, case when review_id % 4 = 0 then 'platform_approved' else 'creator_approved' end from reviews where not bad
 union all select review_id, 'metadata.comparability', case when not applicable then 'INFO' when compared > 0 then 'PASS' else 'WARNING' end, case when not applicable then 'not applicable: manual_publication' when compared > 0 then 'compared ' || compared else 'schema versions differ for ' || mismatched end from reviews where not bad
 union all select review_id, 'geometry.delta', 'INFO', case when geo then 'missing=' || m || ' spread_missing=' || sm || ' false=' || f else 'not applicable: manual_publication' end from reviews where not bad
 union all select review_id, 'geometry.false_panels', 'WARNING', f::varchar from reviews where not bad and geo and f > 0
 union all select review_id, 'delta.deterministic', 'PASS', substr(sha256(review_id::varchar), 1, 12) from reviews where not bad)"""
_AXES_KEY = lambda *pairs: "'cmp_' || substr(sha256(" + " || '|' || ".join(pairs) + "), 1, 12)"

ORACLES = {
    "discovered_issues": f"select {_PREFIX} issue_prefix, r_name publisher_id, n_name title_group_id, c_mktsegment series_id, c_custkey::varchar issue_id from {_PLACES} where c_acctbal >= 0",
    "scanned_issues": f"""select {_PREFIX} issue_prefix, r_name publisher_id, n_name title_group_id, c_mktsegment series_id, c_custkey::varchar issue_id,
 case when c_custkey % 9 <> 0 then 'k/' || c_custkey end revision_key, case when c_custkey % 9 = 0 then 'no_revision_key' end reject_reason from {_PLACES} where c_acctbal >= 0""",
    "identity_conflicts": f"select o_orderkey from orders join ({_PLACES}) on o_custkey = c_custkey where o_orderpriority like '1%' and c_mktsegment <> 'MACHINERY'".replace(f"({_PLACES})", "customer"),
    "resolved_pointers": "select o_orderkey::varchar issue_prefix, case when o_orderstatus <> 'O' then 'rev_' || o_orderkey end revision_id, case when o_orderstatus <> 'P' then 'k/' || o_orderkey else '' end revision_key, case o_orderstatus when 'O' then 'no_revision_id' when 'P' then 'no_revision_key' end reject_reason from orders",
    "snapshot_files": f"""with s as (select s_suppkey::varchar issue_prefix, s_nationkey % 7 k, s_name from supplier), f as (select *, unnest([{_FILES}]) path, unnest([0, 1, 2]) i from s)
select issue_prefix, path, sha256(s_name || '#' || i) sha256, null reject_reason from f where k > 4 union all select issue_prefix, null, null, case k when 0 then 'missing_snapshot' else 'snapshot_hash' end from s where k < 2
union all select issue_prefix, path, null, case k when 2 then 'file_hash' else 'bad_base64' end from f where (k = 2 and i = 0) or (k = 4 and i = 1)
union all select issue_prefix, path, null, 'missing_file' from f where (k = 2 and i = 0) or (k = 4 and i = 1) or (k = 3 and i = 2)""",
    "contract_records": "select conv_id, cast(turn as bigint) turn, role from conversations where conv_id % 7 <> 0",
    "evidence": f"""with s as (select s_suppkey::varchar issue_prefix, s_nationkey n, s_acctbal < 0 owing, s_name, unnest([{', '.join(f"'{r}'" for r in I.ROLES)}]) "role", unnest([0, 1, 2, 3]) k from supplier),
e as (select issue_prefix, "role", k, case when (n + k) % 5 <> 0 then 'read' when not owing then 'missing' when n % 2 = 0 then 'denied' else 'error' end status, case when (n + k) % 5 <> 0 then s_name || '/' || "role" end c from s)
select issue_prefix, "role", status, cast(strlen(c) as bigint) size, sha256(c) sha256, count(*) filter (where status = 'read') over w loaded, count(*) over w expected, count(*) filter (where status = 'read' and k < 2) over w = 2 audit_ready from e window w as (partition by issue_prefix)""",
    "certified_states": "select o_orderkey review_id, case o_orderstatus when 'F' then 'platform_' || o_orderpriority when 'O' then 'creator_approved' else 'draft' end certified_state from orders",
    "review_identifiers": "select o_orderkey, 'rev_' || substr(sha256(o_orderkey::varchar), 1, 12) review_id, cast(case when o_orderstatus = 'F' then 24 else o_custkey end as integer) page from orders",
    "methodology_fingerprints": "select 'fp_' || substr(sha256('algorithm_version=' || o_orderpriority || '|evaluation_version=1|report_version=' || o_orderstatus), 1, 12) fingerprint, count(*) runs from orders group by 1",
    "written_differences": "select o_orderkey, case when o_orderstatus = 'P' then 'missing' else 'differs' end why from orders where o_orderstatus = 'P' or o_orderpriority like '1%'",
    "index_details": f"""{revision_plans.W} select review_id report_id, 'cmp_' || (review_id % 2) comparability_key, field, count(*) filter (where category = 'accepted_unchanged') accepted, count(*) filter (where is_rewrite) edited, count(*) expected from weighted w
where review_id % 7 <> 0 and review_id % 10 <> 3 and exists (select 1 from weighted x where x.review_id = w.review_id and x.category <> 'abstention') group by 1, 2, 3""",
    "review_findings": f"with {_FINDINGS} select * from findings",
    "delta_summary": f"""with {_REVIEWS}, s as (select *, case when not applicable then 'not_applicable' when compared > 0 then 'computed' else 'abstained' end ms, case when geo then 'computed' else 'not_applicable' end gs from reviews)
select review_id, ms metadata_status, case ms when 'abstained' then 'schema_version_mismatch' when 'not_applicable' then 'manual_publication' end metadata_reason, case when ms = 'computed' then compared end metadata_compared, case when ms = 'computed' then acceptance_rate end metadata_acceptance_rate,
 case when ms = 'computed' then edit_rate end metadata_edit_rate, case when ms = 'computed' then addition_rate end metadata_addition_rate, case when ms = 'abstained' then mismatched end mismatched_artifacts, gs geometry_status, case when not geo then 'manual_publication' end geometry_reason,
 {', '.join(f'case when geo then {c} end geometry_{n}' for n, c in (('precision', '"precision"'), ('recall', 'recall'), ('split_rate', 'split_rate'), ('merge_rate', 'merge_rate'), ('missing', 'm'), ('spread_missing', 'sm'), ('false', 'f')))}, corrections correction_ledger_entries from s""",
    "state_comparison": f"""with {_REVIEWS} select review_id, case when review_id % 4 = 0 then 'platform_approved' else 'creator_approved' end canonical_dataset_state, review_id % 4 <> 3 passes_integrity, approved approved_panel_count, geo geometry_applicable, applicable metadata_applicable, compared metadata_compared_artifacts, r0 = 'read' and r1 = 'read' and r2 = 'read' audit_ready from reviews""",
    "report_rows": f"""with {_FINDINGS}, c as (select review_id, count(*) filter (where severity = 'FAIL') n_fail, count(*) filter (where severity = 'WARNING') n_warning, count(*) filter (where severity = 'INFO') n_info, count(*) filter (where severity = 'PASS') n_pass, string_agg(distinct code, ',' order by code) finding_codes from findings group by 1),
k as (select *, {_AXES_KEY("'iou_threshold=0.5'", "'task=geometry'")} gk, {_AXES_KEY("'schema='", "'x'").replace("'schema=' || '|' || 'x'", "'schema=' || case when review_id % 2 = 0 then '1.1' else '2' end || '|task=metadata'")} mk from reviews join c using (review_id) where not bad)
select review_id, {', '.join(f'case when geo then {c} end {n}' for n, c in (('"precision"', '"precision"'), ('recall', 'recall'), ('split_rate', 'split_rate'), ('merge_rate', 'merge_rate'), ('missing_count', 'm'), ('spread_missing_count', 'sm'), ('false_count', 'f')))}, n_fail, n_warning, n_info, n_pass, finding_codes,
 case when n_fail > 0 then 'FAIL' when n_warning > 0 then 'WARNING' when n_info > 0 then 'INFO' else 'PASS' end worst_severity, gk geometry_comparability_key, mk metadata_comparability_key,
 'run_' || substr(sha256('rev_' || review_id || '|gen_' || review_id || '|' || gk || '|' || mk), 1, 16) run_id, '2024-01-01' event_time, case when review_id % 4 = 0 then '2024-01-02' end certified_at from k""",
    "materialized_projections": f"""with h as ({benchmark_plans.ORACLES['benchmark_hierarchy']}), {V.REGISTRY}, g as (select publisher, title_group, series, grouping(publisher, title_group, series) b from registry group by rollup (publisher, title_group, series))
select 'benchmark' projection, "level", '2024-01-01T00:00:00Z' generated_at, count(*) "rows", 'rebuilt' status from h group by 2 union all select 'registry', b::varchar, '2024-01-01T00:00:00Z', count(*), 'rebuilt' from g group by 2""",
}
