"""Queries that draw several blocks together."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import digest as D
from folioscope.operators import history as H
from folioscope.operators import quality as Q
from folioscope.operators import reports as S
from folioscope.plans import quality_plans as P
from folioscope.plans import views as V


def _history(spark, d):
    """Snapshots of the sources: five audits one after another, each with a fifth of the documents more, the last with all."""
    seen = V.artifacts(spark, d).withColumn("day", F.explode(F.expr("transform(sequence(cast(artifact_id % 5 as int) + 1, 5), k -> cast(k as string))")))
    scores = seen.groupBy("dataset", "day").agg(F.count("*").alias("artifacts"), F.bround(F.lit(100.0) * F.count_if("reviewed") / F.count("*"), 0).cast("int").alias("quality_score"))
    failures = Q.failure_rows(seen.withColumn("dataset", F.struct("dataset", "day"))).groupBy("dataset.dataset", "dataset.day", "failure").agg(F.count("*").alias("failures"))
    return scores, failures


def daily_digest(spark, d):
    scores, failures = _history(spark, d)
    queue = Q.priority_rank(Q.assess(V.artifacts(spark, d)))
    delta = H.since_previous(scores, ["quality_score"])
    domains = {f[0]: f[1] for f in Q.FAILURES}
    return D.daily_digest(P.dataset_scores(spark, d), P.retrieval_readiness(spark, d), P.highest_leverage(spark, d), queue, delta, H.new_and_resolved(failures, newest=True), H.stagnant_domains(failures, scores, domains))


def consolidated_findings(spark, d):
    causes = P.root_cause(spark, d).where("impact <> 'low'").select("dataset", "severity", F.col("failure").alias("finding"), F.concat(F.lit("fix_"), "domain").alias("recommendation"))
    blockers = P.artifact_blockers(spark, d).where("impact <> 'low'").select("dataset", "severity", F.col("blocker").alias("finding"), F.concat(F.lit("fix_"), F.when(F.col("blocker").startswith("missing"), "enrichment").otherwise("retrieval")).alias("recommendation"))
    backlogs = P.dataset_findings(spark, d).where("artifact_id is null").select("dataset", "severity", "finding", F.concat(F.lit("fix_"), F.split_part("finding", F.lit("_"), F.lit(1))).alias("recommendation"))
    gaps = P.packet_blockers(spark, d).select("dataset", "severity", F.col("blocker").alias("finding"), F.lit("fix_retrieval").alias("recommendation"))
    return S.consolidated({"root_cause": causes, "dataset": backlogs, "packets": gaps, "retrieval": blockers}).select("dataset", "source", "severity", "finding", "recommendation", "first")


QUERIES = [daily_digest, consolidated_findings]

_sub = lambda name: f"({P.ORACLES[name]})"
ORACLES = {
    "daily_digest": f"""with {P.ASSESSED}, seen as (select s.*, unnest(range(artifact_id % 5 + 1, 6)) k from sig s),
sc as (select dataset, k, count(*) n, cast(round_even(100.0 * count(*) filter (where reviewed) / count(*), 0) as integer) q from seen group by 1, 2),
dl as (select dataset, q - lag(q) over w quality_delta, lag(q) over w before, row_number() over (partition by dataset order by k desc) z from sc window w as (partition by dataset order by k)),
fl as (select dataset, k, failure, count(*) n from (select dataset, k, unnest([{', '.join(f"case when {p} then '{n}' end" for n, _, _, _, p in Q.FAILURES)}]) failure from seen) where failure is not null group by 1, 2, 3),
fd as (select dataset, k, row_number() over (partition by dataset order by k desc) z from (select distinct dataset, k from fl)),
lf as (select dataset, failure from fl join fd using (dataset, k) where z = 1), bf as (select dataset, failure from fl join fd using (dataset, k) where z = 2),
nw as (select dataset, string_agg(failure, ',' order by failure) v from (select * from lf except select * from bf) where dataset in (select dataset from fd where z = 2) group by 1),
rs as (select dataset, string_agg(failure, ',' order by failure) v from (select * from bf except select * from lf) where dataset in (select dataset from fd where z = 2) group by 1),
kinds as (select unnest([{', '.join(f"'{f[0]}'" for f in Q.FAILURES)}]) failure, unnest([{', '.join(f"'{f[1]}'" for f in Q.FAILURES)}]) domain),
sh as (select fd.dataset, fd.k, domain, cast(round_even(100.0 * coalesce(fl.n, 0) / sc.n, 0) as integer) x from fd join sc on sc.dataset = fd.dataset and sc.k = fd.k cross join kinds left join fl on fl.dataset = fd.dataset and fl.k = fd.k and fl.failure = kinds.failure),
mn as (select dataset, k, domain, cast(round_even(avg(x), 0) as integer) x from sh group by 1, 2, 3), ed as (select dataset, domain, arg_min(x, k) f, arg_max(x, k) l, count(*) c from mn group by 1, 2),
st as (select dataset, string_agg(domain, ',' order by domain) v from ed where c >= 2 and abs(l - f) <= 1 and l > 0 group by 1)
select s.dataset, s.quality, s.artifacts, quality_delta, verdict, weaknesses, failure top_failure, n top_failures, review_first, nw.v new_failures, rs.v resolved_failures, st.v stagnant_domains
from {_sub('dataset_scores')} s left join {_sub('retrieval_readiness')} r on s.dataset = r.dataset
left join (select dataset, quality_delta from dl where z = 1 and before is not null) dl on dl.dataset = s.dataset
left join {_sub('highest_leverage')} l on l.dataset = s.dataset and leverage_rank = 1
left join (select dataset, string_agg(artifact_id::varchar, ',' order by priority) review_first from {_sub('priority_rank')} where priority <= 5 group by 1) q on q.dataset = s.dataset
left join nw on nw.dataset = s.dataset left join rs on rs.dataset = s.dataset left join st on st.dataset = s.dataset""",
    "consolidated_findings": f"""with f as (select dataset, 'root_cause' source, 0 k, severity, failure finding, 'fix_' || domain recommendation from {_sub('root_cause')} where impact <> 'low'
 union all select dataset, 'dataset', 1, severity, finding, 'fix_' || split_part(finding, '_', 1) from {_sub('dataset_findings')} where artifact_id is null union all select dataset, 'packets', 2, severity, blocker, 'fix_retrieval' from {_sub('packet_blockers')}
 union all select dataset, 'retrieval', 3, severity, blocker, 'fix_' || case when blocker like 'missing%' then 'enrichment' else 'retrieval' end from {_sub('artifact_blockers')} where impact <> 'low')
select dataset, source, severity, finding, recommendation, row_number() over (partition by dataset, recommendation order by k, finding) = 1 "first" from f""",
}
