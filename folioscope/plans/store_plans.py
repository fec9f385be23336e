"""Queries of the registry, materials and report-store operators over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.operators import benchmarks as B
from folioscope.operators import materials as M
from folioscope.operators import registry as G
from folioscope.operators import reports as S
from folioscope.operators import tables as T
from folioscope.functions.columns import GROUNDING_CLASSES
from folioscope.plans import views as V
from folioscope.plans.benchmark_plans import _reports
from folioscope.storage import shared_folder

PLACE = ["publisher", "title_group", "series", "issue"]


def registry_linkage(spark, d):
    reg = V.registry(spark, d).withColumn("revision", F.col("revision") % 1000)
    log = V.attempts(spark, d).where("fingerprint = 'fp_0115'")
    audited = log.where("status = 'processed'").select("revision").distinct()
    failed = log.where("status = 'failed'").groupBy("revision").agg(F.max_by("failure_stage", "attempt").alias("failure_stage"))
    return G.linkage(reg, audited, failed).select(*PLACE, "revision", "linked_state", "failure_stage")


def _health(spark, d):
    return G.issue_health(V.registry(spark, d))


def issue_health(spark, d):
    return _health(spark, d).select(*PLACE, "health", "reasons")


def series_health(spark, d):
    return G.series_health(_health(spark, d))


def publisher_health(spark, d):
    return G.publisher_health(G.series_health(_health(spark, d)))


def cross_series_health(spark, d):
    return G.cross_series_health(G.series_health(_health(spark, d)))


def series_summary(spark, d):
    return G.series_summary(G.series_health(_health(spark, d)))


def registry_rollup(spark, d):
    return G.rollup(V.registry(spark, d))


def _effective(spark, d):
    return M.effective(*V.materials(spark, d))


def effective_materials(spark, d):
    return _effective(spark, d).select("target_id", "material_id", "level", "revision")


def materials_cross_check(spark, d):
    """Resolved materials with their files (the suppliers' sizes) against the published ones, which lag behind where the part is large."""
    files = F.array(F.struct(F.concat(F.lit("f"), (F.col("revision") % 7).cast("string")).alias("file_id"), F.col("revision").cast("string").alias("revision")), F.struct(F.lit("base").alias("file_id"), F.col("material_id").cast("string").alias("revision")))
    computed = _effective(spark, d).withColumn("files", files)
    part = V.table(spark, d, "part").select(F.col("p_partkey").alias("revision"), "p_size")
    published = V.materials(spark, d)[0].where("status = 'publisher_approved'").join(part, "revision")
    stale = F.array_sort(F.transform(files, lambda f: F.struct(f["file_id"].alias("file_id"), F.when(F.col("p_size") > 40, F.concat(f["revision"], F.lit("-old"))).otherwise(f["revision"]).alias("revision"))))
    published = published.select("target_id", "material_id", stale.alias("files"))
    versions = published.select("target_id").union(computed.select("target_id")).distinct()
    versions = versions.select("target_id", F.when(F.col("target_id").endswith("5"), "9").otherwise("1").alias("contract_version"), F.when(F.col("target_id").endswith("4"), "0").otherwise("1").alias("published_version"))
    return M.cross_check(computed, published, versions)


def authoring_findings(spark, d):
    return M.authoring_findings(*V.materials(spark, d))


def lineage_conflicts(spark, d):
    return M.lineage_conflicts(*V.materials(spark, d))


def _grounding(spark, d):
    """An order's parts as the materials of an output: those of low discount ground the generated side, those of low tax the approved one."""
    lines = V.table(spark, d, "lineitem").select((F.col("l_orderkey") % 5000).alias("artifact_id"), (F.col("l_partkey") % 50).alias("material_id"), F.col("l_linenumber").alias("revision"), "l_discount", "l_tax")
    return M.grounding_changes(lines.where("l_discount <= 0.06"), lines.where("l_discount > 0.06 or l_tax <= 0.05"))


def grounding_categories(spark, d):
    return _grounding(spark, d)


def _outputs(spark, d):
    """One row per output: its review, disposition and the version pin of either side (null: not grounded)."""
    pin = lambda n, k: F.when(F.col(n) > 0, F.when(F.col("artifact_id") % 7 == k, "v2/1").otherwise("v1/1"))
    changes = _grounding(spark, d).withColumn("review_id", F.col("artifact_id") % 50)
    return changes.select("*", F.when(F.col("artifact_id") % 8 == 0, "preserved_approved").when(F.col("artifact_id") % 2 == 0, "fresh").alias("disposition"), pin("before", 3).alias("generated_pin"), pin("after", 4).alias("approved_pin"))


def grounding_benchmark(spark, d):
    return M.grounding_benchmark(_outputs(spark, d), "review_id")


def ledger_state(spark, d):
    return S.ledger_state(V.attempts(spark, d))


def ledger_maintained(spark, d):
    """The ledger kept as a table: attempts come in three loads, the last of which runs twice as if it had broken off."""
    log = V.attempts(spark, d)
    table = T.ledger_table(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}", buckets=16)
    for number in (0, 1, 2, 2):
        part = log.where(F.pmod(F.xxhash64("attempt"), F.lit(3)) == number)
        table.load(T.ledger_of(part), number, T.fold_ledger)
    return T.ledger_rows(table.read()).withColumn("revision", F.col("revision").cast(log.schema["revision"].dataType))


def index_incremental(spark, d):
    """The index kept as a table: all reports, then those of finished orders anew, then a few of them once more."""
    schema = "report_id long, at string, comparability_key string, load int"
    entries = B.keyed(V.reports(spark, d), V.AXES).select(F.col("report_id").cast("long").alias("report_id"), F.col("measured").alias("at"), "comparability_key", "iou_threshold", F.lit(0).alias("load"))
    done = entries.where("iou_threshold = 'F'").withColumn("load", F.lit(1)).withColumn("comparability_key", F.lit("cmp_first"))
    few = done.where("report_id % 97 = 1").withColumn("load", F.lit(2)).withColumn("comparability_key", F.lit("cmp_second"))
    table = T.KeyedTable(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", ["report_id"], schema, buckets=16)
    for number, part in enumerate((entries, done, few)):
        table.load(part.drop("iou_threshold"), number, T.keep_latest(["report_id"], "load"))
    return table.read().drop("load")


def unprocessed_eligible(spark, d):
    log = V.attempts(spark, d)
    return S.unprocessed(log.select("revision").distinct(), log, "fp_0120")


def multi_issue_status(spark, d):
    return S.status_counts(V.attempts(spark, d), ["fingerprint"])


def _fresh(spark, d):
    runs = V.reports(spark, d).select(*PLACE, F.col("measured").alias("at"), "geometry_detector_version", "report_id")
    return runs.drop("report_id").withColumn("run_id", S.run_id(*[F.col(c) for c in (*PLACE, "at", "geometry_detector_version")])).dropDuplicates(["run_id"])


def run_seq_assign(spark, d):
    fresh = _fresh(spark, d)
    stored = fresh.where("issue % 2 = 0").groupBy(*PLACE).agg(F.lit(10).cast("long").alias("run_seq"))
    return S.number_runs(fresh, stored, PLACE).select(*PLACE, "run_id", "run_seq", "report_id")


def idempotent_publish(spark, d):
    fresh = _fresh(spark, d)
    stored = S.number_runs(fresh.where("at < '1996-01-01'"), fresh.limit(0).withColumn("run_seq", F.lit(0)), PLACE)
    added = S.publish(fresh.unionByName(fresh), stored, PLACE)
    return added.select(*PLACE, "run_id", "run_seq")


def report_index_query(spark, d):
    index = _reports(spark, d).withColumn("precision", F.bround(F.col("precision") / F.col("den"), 6)).withColumn("recall", F.bround(F.col("recall") / F.col("den"), 6))
    found = S.search_index(index, equal={"iou_threshold": "F"}, within={"precision": (0.2, 0.6), "recall": (0.5, None)}, contains={"geometry_detector_version": "urg"}, dates=("measured", "1993-01-01", "1997-12-31"))
    return found.select("report_id", "precision", "recall", "measured", "comparability_key")


def _archive(spark, d):
    """Reports with their metrics and findings, and failed attempts, in one archive."""
    share = lambda c: F.bround(F.col(c) / F.col("den"), 6)
    codes = F.filter(F.array(F.lit("evidence.loaded"), F.when(F.col("false_rate") > 0, "geometry.false_panels"), F.when(F.col("missing_rate") > 1, "metadata.comparability")), lambda x: x.isNotNull())
    done = _reports(spark, d).select(
        F.col("report_id").alias("run_seq"), F.col("series").alias("scope"), F.col("measured").alias("at"), "comparability_key", F.concat(F.lit("rev_"), F.col("issue").cast("string")).alias("published_revision_id"),
        F.concat(F.lit("gen_"), F.col("report_id").cast("string")).alias("generated_snapshot_revision_id"), F.concat(F.lit("pub"), F.sha2(F.col("issue").cast("string"), 256)).alias("publisher_commit"), share("precision").alias("precision"), share("recall").alias("recall"),
        codes.alias("finding_codes"), F.map_from_arrays(F.array(F.lit("WARNING"), F.lit("FAIL")), F.array(F.col("false_rate"), F.col("missing_rate"))).alias("finding_counts"), F.concat_ws(" ", F.lit("Review"), "geometry_detector_version").alias("recommendation_text"),
    )
    failed = V.attempts(spark, d).where("status = 'failed'").select(F.col("attempt").alias("run_seq"), F.col("fingerprint").alias("scope"), "at", "failure_stage")
    return S.archive(done, failed)


def archive_search(spark, d):
    """Failed runs of one stage, newest first."""
    return S.search_archive(_archive(spark, d), kinds=["failed_run"], fields={"failure_stage": "publish"}).select("kind", "run_seq", "scope", "at", "failure_stage", "place")


def archive_findings(spark, d):
    """Reports by a metric's range, a finding, a severity, a revision on either side, part of a commit, dates and advice."""
    hits = S.search_archive(
        _archive(spark, d), ranges=[("precision", "<", 0.8), ("recall", ">=", 0.2)], fields={"date_from": "1993-01-01", "date_to": "1997-12-31", "commit": "a1"}, findings=["geometry.false_panels"], severities=["FAIL"], texts=["URGENT"], kinds=["report"]
    )
    return hits.select("run_seq", "scope", "at", "precision", "recall", "published_revision_id", "place")


def archive_counts(spark, d):
    return _archive(spark, d).groupBy("kind", "scope").agg(F.count("*").alias("runs"), F.max("at").alias("newest"), F.count("comparability_key").alias("comparable"))


def archive_boundaries(spark, d):
    return S.archive_boundaries(_reports(spark, d), PLACE[:3]).select("report_id", "comparability_key", "newer_key", "boundary")


def latest_reports(spark, d):
    return S.latest(_reports(spark, d), PLACE).select(*PLACE, "run_seq", "comparability_key")


def index_upsert(spark, d):
    """The index of all reports, replaced by the rows of a later load: two for each report of a finished order, the second of which counts."""
    entries = B.keyed(V.reports(spark, d), V.AXES).select("report_id", F.col("measured").alias("at"), "comparability_key", "iou_threshold", F.lit(0).alias("load"))
    fresh = entries.where("iou_threshold = 'F'")
    fresh = fresh.withColumn("load", F.lit(1)).withColumn("comparability_key", F.lit("cmp_first")).unionByName(fresh.withColumn("load", F.lit(2)).withColumn("comparability_key", F.lit("cmp_second")))
    return S.upsert(entries, fresh, ["report_id"], "load").drop("load", "iou_threshold")


QUERIES = [
    registry_linkage, issue_health, series_health, publisher_health, cross_series_health, series_summary, registry_rollup, effective_materials, materials_cross_check, authoring_findings, lineage_conflicts,
    grounding_categories, grounding_benchmark, ledger_state, ledger_maintained, index_incremental, unprocessed_eligible, multi_issue_status, run_seq_assign, idempotent_publish, report_index_query, archive_search, archive_findings, archive_counts,
    archive_boundaries, latest_reports, index_upsert,
]

HEALTH = V.REGISTRY + """, issues as (select *, case when revision is null then 'no_published_revision' else reasons0 end reasons, case when revision is null then 'unknown' when reasons0 <> '' then 'attention' else 'healthy' end health
  from (select *, concat_ws(',', case when state <> 'platform_approved' then 'not_platform_approved' end, case when audit_state = 'failed' then 'audit_failed' end, case when audit_state = 'unprocessed' then 'audit_pending' end) reasons0 from registry)),
per_series as (select *, case when attention > 0 then 'attention' when healthy = issues then 'healthy' else 'unknown' end health from (
  select publisher, title_group, series, count(*) issues, count(*) filter (where health = 'healthy') healthy, count(*) filter (where health = 'attention') attention, count(*) filter (where health = 'unknown') unknown from issues group by 1, 2, 3))"""
_RANK = """case "level" when 'issue' then 0 when 'series' then 1 when 'title_group' then 2 when 'publisher' then 3 else 99 end"""
_KEY = "'run_' || substr(sha256(concat_ws('|', publisher, title_group, series, issue, measured, geometry_detector_version)), 1, 16)"
EFFECTIVE = V.MATERIALS + f""",
s0 as (select target_id, material_id, "level", status, revision, {_RANK} r from materials where status <> 'retired' and edition_id is null qualify row_number() over (partition by target_id, material_id order by {_RANK}, revision desc) = 1),
bound as (select distinct target_id, material_id by_id, {_RANK} by_r, supersedes_id material_id from edges where binding_status = 'bound'),
""" + ",\n".join(
    f"s{k + 1} as (select * from s{k} x where x.r <= {k} or not exists (select 1 from bound b join s{k} y on y.target_id = b.target_id and y.material_id = b.by_id and y.r = b.by_r where y.r = {k} and b.target_id = x.target_id and b.material_id = x.material_id))" for k in range(4)
) + ", effective as (select * from s4 where status = 'publisher_approved')"
GROUNDING = """b as (select l_orderkey % 5000 artifact_id, l_partkey % 50 material_id, max(l_linenumber) b from lineitem where l_discount <= 0.06 group by 1, 2), a as (select l_orderkey % 5000 artifact_id, l_partkey % 50 material_id, max(l_linenumber) a from lineitem where l_discount > 0.06 or l_tax <= 0.05 group by 1, 2),
g as (select coalesce(a.artifact_id, b.artifact_id) artifact_id, count(b) "before", count(a) "after", count(*) filter (where b is null) added, count(*) filter (where a is null) removed, count(*) filter (where a <> b) revised
  from b full join a on a.artifact_id = b.artifact_id and a.material_id = b.material_id group by 1),
changes as (select *, case when "before" = 0 and "after" = 0 then 'abstention' when added = 0 and removed = 0 and revised = 0 then 'accepted_unchanged' when added > 0 and removed > 0 then 'grounding_replaced' when added > 0 then 'grounding_added' when removed > 0 then 'grounding_removed' else 'revision_changed' end category from g)"""
RUNS = V.REPORTS + f", runs as (select distinct publisher, title_group, series, issue, measured \"at\", {_KEY} run_id from reports)"

_ARCHIVE = f"""{V.REPORTS}, {V.ATTEMPTS}, both_kinds as (
 select 'report' kind, report_id run_seq, series "scope", measured "at", round_even("precision" / den, 6) "precision", round_even(recall / den, 6) recall, issue, false_rate, missing_rate, geometry_detector_version advice, null failure_stage from keyed
 union all select 'failed_run', attempt, fingerprint, "at", null, null, null, null, null, null, failure_stage from attempts where status = 'failed'),
placed as (select *, row_number() over (partition by "scope" order by "at" desc, run_seq desc) place from both_kinds)"""

ORACLES = {
    "registry_linkage": f"""with {V.REGISTRY}, {V.ATTEMPTS}, l as (select * from attempts where fingerprint = 'fp_0115'), f as (select revision, arg_max(failure_stage, attempt) failure_stage from l where status = 'failed' group by 1),
r as (select publisher, title_group, series, issue, revision % 1000 revision from registry),
j as (select r.*, case when r.revision is null then 'no_revision' when r.revision in (select revision from l where status = 'processed') then 'audited' when f.revision is not null then 'failed' else 'unprocessed' end linked_state, failure_stage from r left join f on r.revision = f.revision)
select publisher, title_group, series, issue, revision, linked_state, case when linked_state = 'failed' then failure_stage end failure_stage from j""",
    "issue_health": f"with {HEALTH} select publisher, title_group, series, issue, health, reasons from issues",
    "series_health": f"with {HEALTH} select * from per_series",
    "publisher_health": f"""with {HEALTH}, p as (select publisher, count(*) series_count, cast(sum(issues) as bigint) issues, cast(sum(healthy) as bigint) healthy, cast(sum(attention) as bigint) attention, cast(sum(unknown) as bigint) unknown, count(*) filter (where health = 'attention') series_in_attention from per_series group by 1)
select *, case when attention > 0 then 'attention' when healthy = issues then 'healthy' else 'unknown' end health from p""",
    "cross_series_health": f"with {HEALTH} select publisher, title_group, series, health, issues, healthy, attention, unknown from per_series where health <> 'healthy'",
    "series_summary": f"with {HEALTH} select health, count(*) series_count, cast(sum(issues) as bigint) issues from per_series group by 1",
    "registry_rollup": f"with {V.REGISTRY} select publisher, title_group, series, count(*) issues, count(revision) published, grouping(publisher, title_group, series) level_bits from registry group by rollup (publisher, title_group, series)",
    "effective_materials": f'with {EFFECTIVE} select target_id, material_id, "level", revision from effective',
    "materials_cross_check": f"""with {EFFECTIVE}, c as (select target_id, material_id, 'f' || (revision % 7) f, revision::varchar fr, material_id::varchar br from effective),
p as (select m.target_id, m.material_id, 'f' || (revision % 7) f, revision || case when p_size > 40 then '-old' else '' end fr, m.material_id || case when p_size > 40 then '-old' else '' end br from materials m join part on p_partkey = revision where status = 'publisher_approved'),
pn as (select target_id, material_id, count(*) n, max((f, fr, br)) k from p group by 1, 2),
j as (select coalesce(c.target_id, pn.target_id) target_id, coalesce(c.material_id, pn.material_id) material_id, c.f is null no_c, pn.n, (c.f, c.fr, c.br) ck, pn.k from c full join pn on c.target_id = pn.target_id and c.material_id = pn.material_id)
select target_id, case when not skip then material_id end material_id, status from (
  select target_id, material_id, target_id like '%4' skip, case when n > 1 then 'duplicate' when n is null then 'computed_only' when no_c then 'published_only' when ck = k then 'agree' else 'file_mismatch' end status from j where target_id not like '%5')
where not skip
union all select distinct target_id, cast(null as bigint), case when target_id like '%5' then 'unsupported_resolution_contract_version' else 'version_skew' end from (select target_id from materials where status = 'publisher_approved' union select target_id from effective) where target_id like '%5' or target_id like '%4'""",
    "authoring_findings": f"""with {V.MATERIALS} select *, 'WARNING' severity from (
select target_id, material_id, 'cross_scope_collision' code from materials group by 1, 2 having count(distinct "level") > 1
union all select distinct target_id, supersedes_id, 'dangling_supersedes' from edges e where not exists (select 1 from materials m where m.target_id = e.target_id and m.material_id = e.supersedes_id)
union all select distinct target_id, material_id, 'superseded_still_approved' from materials m where status = 'publisher_approved' and exists (select 1 from edges e where e.target_id = m.target_id and e.supersedes_id = m.material_id and binding_status = 'bound'))""",
    "lineage_conflicts": f"""with recursive {V.MATERIALS}, u as (select target_id, material_id a, supersedes_id b from edges where material_id <> supersedes_id), e as (select target_id, a, b from u union select target_id, b, a from u),
reach as (select target_id, a, a b from e union select r.target_id, r.a, e.b from reach r join e on r.target_id = e.target_id and r.b = e.a),
l as (select target_id, a, min(b) lineage from reach group by 1, 2)
select l.target_id, lineage, count(*) approved, 'multiple_active_approved' code, 'FAIL' severity from l join (select distinct target_id, material_id from materials where status = 'publisher_approved') m on m.target_id = l.target_id and m.material_id = l.a group by 1, 2 having count(*) > 1""",
    "grounding_categories": f"with {GROUNDING} select * from changes",
    "grounding_benchmark": f"""with {GROUNDING}, o as (select *, artifact_id % 50 review_id, case when artifact_id % 8 = 0 then 'preserved_approved' when artifact_id % 2 = 0 then 'fresh' end disposition,
  case when "before" > 0 then case when artifact_id % 7 = 3 then 'v2/1' else 'v1/1' end end gp, case when "after" > 0 then case when artifact_id % 7 = 4 then 'v2/1' else 'v1/1' end end ap from changes),
k as (select *, case when gp <> ap then 'unsupported_version' else category end kind, disposition is null or disposition = 'fresh' fresh from o),
n as (select review_id, count(*) artifacts, {', '.join(f"count(*) filter (where kind = '{k}') n_{k}" for k in GROUNDING_CLASSES)},
  count(*) filter (where kind in ('grounding_added', 'grounding_removed', 'revision_changed', 'grounding_replaced')) grounding_edits,
  count(*) filter (where fresh and kind = 'accepted_unchanged') fresh_accepted, count(*) filter (where fresh and kind not in ('abstention', 'unsupported_version')) fresh_comparable,
  array_to_string(list_sort(list_distinct(list_concat(list(gp) filter (where gp is not null), list(ap) filter (where ap is not null)))), ',') version_pins from k group by 1)
select *, coalesce(round_even(cast(fresh_accepted as double) / nullif(fresh_comparable, 0), 6), 0.0) acceptance, n_unsupported_version > 0 or version_pins like '%,%' version_skew from n""",
    "ledger_state": f"""with {V.ATTEMPTS}, l as (select revision, fingerprint, count(*) attempts, min("at") first_seen, max("at") updated_at from attempts group by 1, 2), z as (select * from attempts qualify row_number() over (partition by revision, fingerprint order by "at" desc, attempt desc) = 1)
select l.*, status, case when status <> 'processed' then failure_stage end failure_stage from l join z using (revision, fingerprint)""",
    "ledger_maintained": f"""with {V.ATTEMPTS}, l as (select revision, fingerprint, count(*) attempts, min("at") first_seen, max("at") updated_at from attempts group by 1, 2), z as (select * from attempts qualify row_number() over (partition by revision, fingerprint order by "at" desc, attempt desc) = 1)
select l.*, status, case when status <> 'processed' then failure_stage end failure_stage from l join z using (revision, fingerprint)""",
    "index_incremental": f"""with {V.REPORTS} select report_id, measured "at", case when iou_threshold = 'F' then case when report_id % 97 = 1 then 'cmp_second' else 'cmp_first' end else comparability_key end comparability_key from keyed""",
    "unprocessed_eligible": f"with {V.ATTEMPTS} select distinct revision from attempts where revision not in (select revision from attempts where fingerprint = 'fp_0120' and status = 'processed')",
    "multi_issue_status": f'with {V.ATTEMPTS} select fingerprint, status, count(*) "rows" from attempts group by 1, 2',
    "run_seq_assign": f"""with {RUNS}, n as (select *, case when issue % 2 = 0 then 10 else 0 end + row_number() over (partition by publisher, title_group, series, issue order by "at", run_id) run_seq from runs)
select publisher, title_group, series, issue, run_id, run_seq, 'run' || lpad(run_seq::varchar, 6, '0') report_id from n""",
    "idempotent_publish": f"""with {RUNS} select publisher, title_group, series, issue, run_id, run_seq from (select *, row_number() over (partition by publisher, title_group, series, issue order by "at", run_id) run_seq from (
  select *, min("at") over (partition by run_id) m from runs)) where "at" >= '1996-01-01'""",
    "report_index_query": f"""with {V.REPORTS}, i as (select report_id, round_even("precision" / den, 6) "precision", round_even("recall" / den, 6) recall, measured, comparability_key, iou_threshold, geometry_detector_version from keyed)
select report_id, "precision", recall, measured, comparability_key from i where iou_threshold = 'F' and "precision" between 0.2 and 0.6 and recall >= 0.5 and contains(lower(geometry_detector_version), 'urg') and measured between '1993-01-01' and '1997-12-31'""",
    "archive_search": f"""with {_ARCHIVE} select 'failed_run' kind, run_seq, "scope", "at", failure_stage, place from placed where kind = 'failed_run' and failure_stage = 'publish'""",
    "archive_findings": f"""with {_ARCHIVE} select run_seq, "scope", "at", "precision", recall, 'rev_' || issue published_revision_id, place from placed where kind = 'report' and "precision" < 0.8 and recall >= 0.2 and "at" between '1993-01-01' and '1997-12-31'
 and contains('pub' || sha256(issue::varchar), 'a1') and false_rate > 0 and missing_rate > 0 and contains(lower('Review ' || advice), 'urgent')""",
    "archive_counts": f"""with {V.REPORTS}, {V.ATTEMPTS} select kind, "scope", count(*) runs, max("at") newest, count(comparability_key) comparable from (
select 'report' kind, series "scope", measured "at", comparability_key from keyed union all select 'failed_run', fingerprint, "at", null from attempts where status = 'failed') group by 1, 2""",
    "archive_boundaries": f"""with {V.REPORTS}, n as (select *, lag(comparability_key) over (partition by publisher, title_group, series order by run_seq desc) newer_key from keyed) select report_id, comparability_key, newer_key, newer_key is not null and newer_key <> comparability_key boundary from n""",
    "latest_reports": f"with {V.REPORTS} select publisher, title_group, series, issue, run_seq, comparability_key from keyed qualify row_number() over (partition by publisher, title_group, series, issue order by run_seq desc) = 1",
    "index_upsert": f"""with {V.REPORTS} select report_id, measured "at", case when iou_threshold = 'F' then 'cmp_second' else comparability_key end comparability_key from keyed""",
}
