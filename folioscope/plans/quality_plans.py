"""Queries of the quality operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import quality as Q
from folioscope.plans import views as V

_RANK = {"high": 3, "medium": 2, "low": 1}
_SQL_REASONS = ", ".join(f"case when {p} then {{'rank': {_RANK[s]}, 'reason': '{n}'}} end" for n, s, p in Q.WEAK_REASONS)
_NAME = lambda c: f"case {c} when 4 then 'critical' when 3 then 'high' when 2 then 'medium' when 1 then 'low' when 0 then 'info' end"
_PCT = lambda n, d: f"cast(round_even(100.0 * {n} / {d}, 0) as integer)"
_IMPACT = lambda c: f"case when {c} >= 50 then 'high' when {c} >= 20 then 'medium' else 'low' end"
_BAND = lambda c: f"case when {c} >= 80 then 'strong' when {c} >= 40 then 'adequate' else 'weak' end"

ASSESSED = V.ARTIFACTS + f""",
sig as (select *, 1 + has_tags::int + (summary_length > 0)::int meta_present, 3 meta_total from artifacts),
reasoned as (select *, list_filter([{_SQL_REASONS}], lambda x: x is not null) reasons from sig),
ranked as (select *, list_max(list_transform(reasons, lambda r: r.rank)) severity_rank, len(reasons) effort,
                  cast(round_even((meta_present / meta_total + has_characters::int + has_dialogue::int + reviewed::int + approved::int) * 100 / 5, 0) as integer) score from reasoned),
assessed as (select *, {_NAME('severity_rank')} severity, list_filter(reasons, lambda r: r.rank = severity_rank)[1].reason primary_weakness from ranked),
failed as (select dataset, artifact_id, page, f.* from (select *, unnest(list_filter([{', '.join(f"case when {p} then {{'failure': '{n}', 'domain': '{d}', 'category': '{c}', 'severity': '{s}'}} end" for n, d, c, s, p in Q.FAILURES)}], lambda x: x is not null)) f from sig)),
causes as (select dataset, failure, domain, category, severity, n, {_PCT('n', 'total')} share, pages, greatest(n - {Q.SAMPLE_IDS}, 0) truncated
           from (select dataset, failure, domain, category, severity, count(*) n, coalesce(array_to_string(list_sort(list_distinct(list(page) filter (page is not null))), ','), '') pages from failed group by all)
           join (select dataset, count(*) total from artifacts group by 1) using (dataset))
"""
CHECKED = ASSESSED + "," + V.PACKETS + f""",
checked as (select *, has_confidence::int + has_matched::int + has_scope::int + all_approved::int checks_passed from (
  select dataset, packet_id, bool_and(has_confidence) has_confidence, bool_and(has_matched) has_matched, bool_and(has_scope) has_scope, bool_and(ok) all_approved, count(*) n_artifacts
  from (select p.*, p.artifact_id in (select artifact_id from artifacts where approved) ok from packet_refs p) group by dataset, packet_id)),
dscores as (select dataset, artifacts, metadata, characters, dialogue, coalesce(retrieval, 0) retrieval from (
  select dataset, count(*) artifacts, {_PCT('sum(meta_present)', 'sum(meta_total)')} metadata, {_PCT('count(*) filter (where has_characters)', 'count(*)')} characters, {_PCT('count(*) filter (where has_dialogue)', 'count(*)')} dialogue
  from sig group by 1) left join (select dataset, {_PCT('sum(checks_passed)', '(4 * count(*))')} retrieval from checked group by 1) using (dataset)),
cover as (select dataset, artifacts, referenced, unknown_refs, {_PCT('referenced', 'artifacts')} coverage from (
  select dataset, artifacts, coalesce(referenced, 0) referenced, coalesce(unknown_refs, 0) unknown_refs
  from (select dataset, count(*) artifacts from artifacts group by 1) left join
       (select dataset, count(*) referenced, count(*) filter (where not known) unknown_refs from (
          select distinct p.dataset, p.artifact_id, exists (select 1 from artifacts a where a.dataset = p.dataset and a.artifact_id = p.artifact_id) known from packet_refs p) group by 1) using (dataset))),
blocked as (select dataset, blocker, severity, n, {_PCT('n', 'total')} share from (
  select dataset, b.blocker, b.severity, count(*) n from (select dataset, unnest(list_filter([{', '.join(f"case when {p} then {{'blocker': '{n}', 'severity': '{s}'}} end" for n, s, p in Q.BLOCKERS)}], lambda x: x is not null)) b from sig) group by all)
  join (select dataset, count(*) total from artifacts group by 1) using (dataset))
"""


def _assessed(spark: SparkSession, d: str) -> DataFrame:
    return Q.assess(V.artifacts(spark, d))


def _approved(arts: DataFrame) -> DataFrame:
    return arts.where("approved").select("artifact_id").distinct()


def _packets(spark: SparkSession, d: str) -> DataFrame:
    return Q.packet_checks(V.packets(spark, d), _approved(V.artifacts(spark, d)))


def _causes(spark: SparkSession, d: str) -> DataFrame:
    arts = V.artifacts(spark, d)
    return Q.root_causes(Q.failure_rows(arts), arts.groupBy("dataset").agg(F.count("*").alias("artifacts")))


def dataset_scores(spark, d):
    return Q.dataset_scores(V.artifacts(spark, d), _packets(spark, d))


def weak_queue(spark, d):
    return Q.weak_queue(_assessed(spark, d)).select("dataset", "artifact_id", "severity", "score", "primary_weakness", "effort", "place")


def weak_summary(spark, d):
    return Q.weak_summary(_assessed(spark, d)).select("dataset", "flagged", "high", "medium", "low")


def priority_rank(spark, d):
    return Q.priority_rank(_assessed(spark, d)).select("dataset", "artifact_id", "severity", "page", "effort", "priority")


def page_heatmap(spark, d):
    return Q.page_heatmap(_assessed(spark, d)).select("dataset", "page_label", "artifacts", "weak", "high", "medium", "low", "impact", "place")


def root_cause(spark, d):
    return _causes(spark, d).drop("category")


def failure_samples(spark, d):
    return Q.sampled_ids(Q.failure_rows(V.artifacts(spark, d)))


def highest_leverage(spark, d):
    return Q.highest_leverage(_causes(spark, d)).select("dataset", "failure", "category", "n", "leverage_rank")


def failure_clusters(spark, d):
    arts = V.artifacts(spark, d)
    return Q.failure_clusters(Q.failure_rows(arts), arts)


def packet_checks(spark, d):
    return _packets(spark, d)


def packet_coverage(spark, d):
    return Q.packet_coverage(V.packets(spark, d), V.artifacts(spark, d))


def packet_findings(spark, d):
    return Q.packet_findings(_packets(spark, d))


def packet_blockers(spark, d):
    return Q.packet_blockers(packet_findings(spark, d), packet_coverage(spark, d), _packets(spark, d))


def artifact_blockers(spark, d):
    return Q.artifact_blockers(V.artifacts(spark, d))


def retrieval_readiness(spark, d):
    return Q.retrieval_readiness(packet_coverage(spark, d), _packets(spark, d), artifact_blockers(spark, d))


def approval_backlog(spark, d):
    arts = V.artifacts(spark, d)
    return Q.approval_backlog(arts, _approved(arts)).select("dataset", "artifact_id", "reviewed")


def dataset_findings(spark, d):
    return Q.dataset_findings(V.artifacts(spark, d))


def page_lookup(spark, d):
    turns = V.table(spark, d, "conversations").select((F.col("conv_id") * 7 + F.col("turn")).alias("artifact_id"), F.array(F.when(F.col("role") == "user", F.col("turn").cast("int") + 1)).alias("page_range"), (F.col("conv_id") * 100 + F.col("turn")).alias("place"))
    packets = turns.withColumn("page_range", F.when(F.get("page_range", F.lit(0)).isNotNull(), F.col("page_range")))
    approved = V.artifacts(spark, d).where("approved").select("artifact_id", F.when(F.col("page").isNotNull(), F.array("page")).alias("page_range"), F.col("artifact_id").alias("place"))
    found = Q.page_lookup(V.artifacts(spark, d).select("dataset", "artifact_id"), packets, approved)
    return found.select("dataset", "artifact_id", F.get("page_range", F.lit(0)).alias("page"))


QUERIES = [
    dataset_scores, weak_queue, weak_summary, priority_rank, page_heatmap, root_cause, failure_samples, highest_leverage, failure_clusters,
    packet_checks, packet_findings, packet_blockers, packet_coverage, artifact_blockers, retrieval_readiness, approval_backlog, dataset_findings, page_lookup,
]

_ORDER = "case severity when 'high' then 3 when 'medium' then 2 else 1 end"
ORACLES = {
    "dataset_scores": f"with {CHECKED} select *, cast(round_even((metadata * 30 + characters * 25 + dialogue * 25 + retrieval * 20) / 100.0, 0) as integer) quality from dscores",
    "weak_queue": f"with {ASSESSED} select dataset, artifact_id, severity, score, primary_weakness, cast(effort as integer) effort, row_number() over (partition by dataset order by severity_rank desc, score, artifact_id) place from assessed where severity is not null",
    "weak_summary": f"with {ASSESSED} select dataset, count(severity) flagged, count(*) filter (where severity = 'high') high, count(*) filter (where severity = 'medium') medium, count(*) filter (where severity = 'low') low from assessed group by 1",
    "priority_rank": f"with {ASSESSED} select dataset, artifact_id, severity, page, cast(effort as integer) effort, row_number() over (partition by dataset order by severity_rank desc, page asc nulls last, effort, artifact_id) priority from assessed where severity is not null",
    "page_heatmap": f"with {ASSESSED} select dataset, coalesce(page::varchar, 'unpaged') page_label, count(*) artifacts, count(severity) weak, count(*) filter (where severity = 'high') high, count(*) filter (where severity = 'medium') medium, count(*) filter (where severity = 'low') low, coalesce({_NAME('max(severity_rank)')}, 'none') impact, cast(row_number() over (partition by dataset order by max(severity_rank) desc nulls last, count(severity) desc, page asc nulls last) as integer) place from assessed group by dataset, page",
    "root_cause": f"with {ASSESSED} select dataset, failure, domain, severity, n, share, {_IMPACT('share')} impact, pages, truncated from causes",
    "failure_samples": f"with {ASSESSED} select * from (select dataset, failure, artifact_id, cast(row_number() over (partition by dataset, failure order by artifact_id) as integer) place from failed) where place <= {Q.SAMPLE_IDS}",
    "highest_leverage": f"with {ASSESSED} select dataset, failure, category, n, cast(case when category = 'content' then row_number() over (partition by dataset, category order by n desc, {_ORDER} desc, failure) end as integer) leverage_rank from causes",
    "failure_clusters": f"""with {ASSESSED}, counted as (select f.*, t from (select dataset, failure, domain, category, severity, count(*) n from failed group by all) f join (select dataset, count(*) t from artifacts group by 1) using (dataset)),
wide as (select *, {_PCT('n', 't')} pct from counted where {_PCT('n', 't')} >= 80),
pages as (select dataset, page, count(*) t from artifacts group by 1, 2),
local as (select f.dataset, f.failure, f.domain, f.category, f.severity, f.page, count(*) n, p.t from failed f join pages p on p.dataset = f.dataset and p.page = f.page where not exists (select 1 from wide w where w.dataset = f.dataset and w.failure = f.failure) group by all),
loose as (select f.dataset, f.failure, f.domain, f.category, f.severity, count(*) n, p.t from failed f join pages p on p.dataset = f.dataset and p.page is null where f.page is null group by all)
select dataset, failure, domain, category, severity, 'issue_wide' scope, cast(null as integer) page, n, t "of", pct percent, {_IMPACT('pct')} impact from wide
union all select dataset, failure, domain, category, severity, 'page', page, n, t, {_PCT('n', 't')}, {_IMPACT(_PCT('n', 't'))} from local where n >= 2 and n * 100 >= t * 50
union all select dataset, failure, domain, category, severity, 'unpaged', null, n, t, null, null from loose where n >= 2""",
    "packet_checks": f"with {CHECKED} select *, checks_passed * 25 packet_score from checked",
    "packet_findings": f"with {CHECKED} " + " union all ".join(f"select dataset, packet_id, '{gap}' gap, '{severity}' severity, '{advice}' recommendation from checked where not {check}" for check, gap, severity, advice in Q.PACKET_GAPS),
    "packet_blockers": f"with {CHECKED} " + " union all ".join(f"select dataset, '{gap}' blocker, '{severity}' severity, count(*) packets from checked where not {check} group by 1" for check, gap, severity, _ in Q.PACKET_GAPS)
    + " union all select dataset, 'low_packet_coverage', case when coverage < 50 then 'high' else 'medium' end, coalesce(n, 0) from cover left join (select dataset, count(*) n from checked group by 1) using (dataset) where coverage < 100",
    "packet_coverage": f"with {CHECKED} select *, case when coverage < 50 then 'high' when coverage < 100 then 'medium' end blocker from cover",
    "artifact_blockers": f"with {CHECKED} select *, {_IMPACT('share')} impact from blocked",
    "retrieval_readiness": f"""with {CHECKED}, w as (
  select c.dataset, coverage, coalesce(g, 0) grounding_quality, coalesce(t, 0) traceability, 100 - coalesce(share, 0) confidence_boundaries from cover c
  left join (select dataset, {_PCT('count(*) filter (where has_confidence)', 'count(*)')} g, {_PCT('count(*) filter (where has_matched and has_scope and all_approved)', 'count(*)')} t from checked group by 1) p on c.dataset = p.dataset
  left join blocked b on b.dataset = c.dataset and blocker = 'no_grounding'),
b as (select *, {', '.join(f"{_BAND(x)} b{k}" for k, x in enumerate(('coverage', 'grounding_quality', 'traceability', 'confidence_boundaries')))} from w)
select dataset, coverage, grounding_quality, traceability, confidence_boundaries,
  {', '.join("concat_ws(',', " + ', '.join(f"case when b{k} = '{s}' then '{x}' end" for k, x in enumerate(('coverage', 'grounding_quality', 'traceability', 'confidence_boundaries'))) + f") {n}" for s, n in (('strong', 'strengths'), ('weak', 'weaknesses')))},
  case when b1 = 'weak' then 'not_ready' when b0 = 'weak' or b2 = 'weak' or b3 = 'weak' then 'partially_ready' else 'ready' end verdict from b""",
    "approval_backlog": f"with {ASSESSED} select dataset, artifact_id, reviewed from artifacts where not approved",
    "dataset_findings": f"""with {V.ARTIFACTS}, c as (select dataset, count(*) t, count(*) filter (where approved) a, count(*) filter (where reviewed) r, count(*) filter (where has_characters) c, count(*) filter (where has_dialogue) g from artifacts group by 1)
select dataset, artifact_id, 'missing_field' finding, 'classification.tags' field, 'high' severity, 1 n, 1 "of" from artifacts where not has_tags
union all select dataset, artifact_id, 'missing_field', 'narrative.summary', 'high', 1, 1 from artifacts where summary_length = 0
union all select dataset, null, 'approval_backlog', null, 'high', t - a, t from c where a < t union all select dataset, null, 'review_backlog', null, 'medium', t - r, t from c where r < t
union all select dataset, null, 'character_coverage', null, 'medium', t - c, t from c where c < t union all select dataset, null, 'dialogue_coverage', null, 'medium', t - g, t from c where g < t""",
    "page_lookup": f"""with {V.ARTIFACTS}, p as (select conv_id * 7 + turn artifact_id, turn + 1 page, 0 source, conv_id * 100 + turn place from conversations where role = 'user'
 union all select artifact_id, page, 1, artifact_id from artifacts where approved and page is not null),
k as (select artifact_id, arg_min(page, (source, place)) page from p group by 1)
select dataset, a.artifact_id, cast(k.page as integer) page from artifacts a left join k on a.artifact_id = k.artifact_id""",
}
