"""Queries of the benchmark and history operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import benchmarks as B
from folioscope.operators import history as H
from folioscope.operators.quality import FAILURES
from folioscope.plans import views as V

SERIES = ["publisher", "title_group", "series"]
METRICS = {m: (m, "den") for m in V.RATES if m != "spread_missing_rate"}
HISTORY = {"quality_score": False, "weak_percent": True}
DOMAINS = {f[0]: f[1] for f in FAILURES}


def _reports(spark, d):
    return B.keyed(V.reports(spark, d), V.AXES)


def _points(spark, d):
    return B.points(_reports(spark, d), METRICS)


def benchmark_hierarchy(spark, d):
    return B.hierarchy_of_reports(_reports(spark, d), METRICS)


def benchmark_points(spark, d):
    return _points(spark, d).where("metric in ('precision', 'recall')").select("report_id", "comparability_key", "metric", "num", "den", F.when(F.col("den") != 0, F.bround(F.col("num") / F.col("den"), 6)).alias("value"))


def benchmark_series_boundaries(spark, d):
    return B.series_boundaries(_reports(spark, d), [*SERIES, "issue"], V.AXES).select(*SERIES, "issue", "run_seq", "comparability_key", "changed", "changed_axes", "segment")


def series_dual_time(spark, d):
    return B.dual_time(_reports(spark, d), SERIES).select("report_id", "event", "measured", "event_place", "measured_place", "late")


#: Failure mode -> metric of the reports with its count, and the column of its denominator.
MODES_OF = {"panel_splits": ("split_rate", "approved"), "panel_merges": ("merge_rate", "generated"), "false_panels": ("false_rate", "generated"), "missing_page_panels": ("missing_rate", "approved"), "spread_missing_panels": ("spread_missing_rate", "approved")}


def _modes(spark, d):
    """Approved panels are the lines that were not returned, generated ones all lines."""
    rows = _reports(spark, d).withColumn("generated", F.col("den")).withColumn("approved", F.col("den") - F.col("false_rate")).drop("den")
    return B.failure_modes(B.points(rows, MODES_OF), SERIES)


def failure_modes(spark, d):
    return _modes(spark, d)


def geometry_recommendations(spark, d):
    return B.recommendations(_modes(spark, d)).select(*SERIES, "comparability_key", "metric", "rate", "code")


def version_improvements(spark, d):
    return B.version_improvements(_points(spark, d), SERIES, V.AXES).select(*SERIES, "comparability_key", "metric", "value", "previous", "delta", "changed_axes", "since")


def prompt_model_correlation(spark, d):
    rows = _points(spark, d).where("metric = 'precision'").withColumn("iou_threshold", F.when(F.col("iou_threshold") != "P", F.col("iou_threshold")))
    return B.correlation(rows, ["geometry_detector_version", "iou_threshold", "publisher"])


def series_comparison(spark, d):
    return B.series_comparison(_points(spark, d), ["precision", "recall", "split_rate"])


def scope_filter(spark, d):
    entries = V.reports(spark, d).withColumn("path", F.concat_ws("/", "publisher", "title_group", "series", F.col("issue").cast("string")))
    return B.scope_filter(entries, "publisher", "EUROPE").select("report_id", "path")


def history_trend(spark, d):
    return H.trends(V.snapshots(spark, d)[0], HISTORY)


def delta_since_previous(spark, d):
    return H.since_previous(V.snapshots(spark, d)[0], list(HISTORY))


def failure_trends(spark, d):
    scores, failures = V.snapshots(spark, d)
    return H.failure_trends(failures, scores)


def failure_changes(spark, d):
    return H.new_and_resolved(V.snapshots(spark, d)[1])


def failure_changes_since_previous(spark, d):
    return H.new_and_resolved(V.snapshots(spark, d)[1], newest=True)


def stagnant_domains(spark, d):
    scores, failures = V.snapshots(spark, d)
    return H.stagnant_domains(failures, scores, DOMAINS)


def observed_correlations(spark, d):
    scores, failures = V.snapshots(spark, d)
    return H.observed_correlations(failures, scores)


def capped_history(spark, d):
    return H.capped(V.snapshots(spark, d)[0]).select("dataset", "day", "artifacts", "quality_score", "weak_percent", "place")


QUERIES = [
    benchmark_hierarchy, benchmark_points, benchmark_series_boundaries, series_dual_time, failure_modes, geometry_recommendations, version_improvements, prompt_model_correlation,
    series_comparison, scope_filter, history_trend, delta_since_previous, failure_trends, failure_changes, failure_changes_since_previous, stagnant_domains, observed_correlations, capped_history,
]

_V = lambda n, d: f"round_even(cast({n} as double) / nullif({d}, 0), 6)"
_A = "geometry_detector_version", "iou_threshold"
_AXES = lambda w: "concat_ws(',', " + ", ".join(f"case when {a} is distinct from lag({a}) over {w} then '{a}' end" for a in _A) + ")"
_DIR = lambda c, low: f"case when abs({c}) <= 1 then 'stable' when {low} then case when {c} < 0 then 'improving' else 'worsening' end when {c} > 0 then 'improving' else 'worsening' end"
MODES = V.REPORTS + f""", counted as (select publisher, title_group, series, comparability_key, unnest([{', '.join(f"'{m}'" for m in MODES_OF)}]) metric, unnest([{', '.join(n for n, _ in MODES_OF.values())}]) num, unnest([{', '.join("den" if d == "generated" else "den - false_rate" for _, d in MODES_OF.values())}]) den from keyed),
modes as (select *, coalesce({_V('failures', 't')}, 0.0) rate, cast(row_number() over (partition by publisher, title_group, series, comparability_key order by failures desc, metric) as integer) "rank" from (
  select publisher, title_group, series, comparability_key, metric, cast(sum(num) as bigint) failures, cast(sum(den) as bigint) t from counted group by all))"""
DENSE = V.SNAPSHOTS + """, dense as (select d.dataset, d."day", k.failure, coalesce(failures, 0) n from (select distinct dataset, "day" from failures) d join (select distinct dataset, failure from failures) k using (dataset)
 left join failures f on f.dataset = d.dataset and f."day" = d."day" and f.failure = k.failure)"""

_CHANGES = f"""with {V.SNAPSHOTS.replace('%', '%%')}, d as (select dataset, "day", row_number() over (partition by dataset order by "day" desc) k, row_number() over (partition by dataset order by "day") j from (select distinct dataset, "day" from failures)),
able as (select dataset from d where k = 2), m as (select dataset, "day", 'first' kind from d where j = 1 union all select dataset, "day", 'previous' from d where k = 2),
l as (select dataset, failure from failures join d using (dataset, "day") where k = 1 and failures > 0), b as (select dataset, failure from failures join m using (dataset, "day") where kind = '%s' and failures > 0)
select dataset, failure, 'new' status from (select * from l except select * from b) where dataset in (select dataset from able) union all select dataset, failure, 'resolved' from (select * from b except select * from l) where dataset in (select dataset from able)"""

ORACLES = {
    "benchmark_hierarchy": f"""with {V.POINTS} select publisher, title_group, series, issue, comparability_key, metric, cast(sum(num) as bigint) numerator, cast(sum(den) as bigint) denominator, count(*) reports,
  count(distinct (publisher, title_group, series, issue)) issues, count(distinct (publisher, title_group, series)) series_count,
  case grouping(publisher, title_group, series, issue) when 0 then 'issue' when 1 then 'series' when 7 then 'publisher' else 'platform' end "level", {_V('sum(num)', 'sum(den)')} "value"
from (select *, publisher p, title_group g, series s, issue i from points) group by grouping sets ((publisher, title_group, series, issue, comparability_key, metric), (publisher, title_group, series, comparability_key, metric), (publisher, comparability_key, metric), (comparability_key, metric))""".replace("count(distinct (publisher, title_group, series, issue))", "count(distinct (p, g, s, i))").replace("count(distinct (publisher, title_group, series))", "count(distinct (p, g, s))"),
    "benchmark_points": f"""with {V.POINTS} select report_id, comparability_key, metric, num, den, {_V('num', 'den')} "value" from points where metric in ('precision', 'recall')""",
    "benchmark_series_boundaries": f"""with {V.REPORTS}, c as (select *, coalesce(comparability_key <> lag(comparability_key) over w, false) changed, {_AXES('w')} axes from keyed window w as (partition by publisher, title_group, series, issue order by run_seq))
select publisher, title_group, series, issue, run_seq, comparability_key, changed, case when changed then axes else '' end changed_axes, cast(sum(changed::int) over (partition by publisher, title_group, series, issue order by run_seq) as bigint) segment from c""",
    "series_dual_time": f"""with {V.REPORTS}, p as (select *, row_number() over (partition by publisher, title_group, series order by coalesce(event, ''), run_seq) event_place, row_number() over (partition by publisher, title_group, series order by coalesce(measured, ''), run_seq) measured_place from reports)
select report_id, event, measured, event_place, measured_place, event_place < measured_place late from p""",
    "failure_modes": f'with {MODES} select publisher, title_group, series, comparability_key, metric, failures, t "of", rate, "rank" from modes',
    "geometry_recommendations": f"with {MODES} select publisher, title_group, series, comparability_key, metric, rate, case metric when 'panel_merges' then 'geometry.under_segmentation' else 'geometry.precision_gap' end code from modes where (metric = 'panel_merges' and rate > 0.5) or (metric = 'false_panels' and rate > 0.15)",
    "version_improvements": f"""with {V.POINTS}, s as (select publisher, title_group, series, comparability_key, geometry_detector_version, iou_threshold, metric, min((measured, run_seq)) st, min(measured) since, {_V('sum(num)', 'sum(den)')} "value" from points group by all),
l as (select *, lag("value") over w previous, {_AXES('w')} changed_axes from s window w as (partition by publisher, title_group, series, metric order by st, comparability_key))
select publisher, title_group, series, comparability_key, metric, "value", previous, round_even("value" - previous, 6) delta, changed_axes, since from l where previous is not null""",
    "prompt_model_correlation": f"""with {V.POINTS} select geometry_detector_version, case when iou_threshold <> 'P' then iou_threshold end iou_threshold, publisher, count(*) reports, cast(sum(num) as bigint) accepted, cast(sum(den) as bigint) comparable, {_V('sum(num)', 'sum(den)')} acceptance
from (select geometry_detector_version, publisher, metric, num, den, iou_threshold from points) where metric = 'precision' group by 1, 2, 3""",
    "series_comparison": f"""with {V.POINTS}, n as (select publisher, title_group, series, arg_max(comparability_key, run_seq) comparability_key, count(distinct comparability_key) methods from points group by 1, 2, 3),
s as (select publisher, title_group, series, comparability_key, metric, count(*) reports, {_V('sum(num)', 'sum(den)')} v from points group by all)
select publisher, title_group, series, comparability_key, methods, max(v) filter (where metric = 'precision') "precision", max(v) filter (where metric = 'recall') recall, max(v) filter (where metric = 'split_rate') split_rate, max(reports) filter (where metric in ('precision', 'recall', 'split_rate')) reports, methods > 1 several_methods
from s join n using (publisher, title_group, series, comparability_key) group by all""",
    "scope_filter": f"with {V.REPORTS} select report_id, publisher || '/' || title_group || '/' || series || '/' || issue path from reports where publisher = 'EUROPE'",
    "history_trend": f"""with {V.SNAPSHOTS}, l as (select dataset, "day", 'quality_score' metric, quality_score v, false low from scores union all select dataset, "day", 'weak_percent', weak_percent, true from scores),
s as (select *, v - lag(v) over (partition by dataset, metric order by "day") step from l),
a as (select dataset, metric, low, count(*) snapshots, arg_min(v, "day") "first", arg_max(v, "day") "last", coalesce(bool_and(step >= 0), true) or coalesce(bool_and(step <= 0), true) mono from s group by 1, 2, 3)
select dataset, metric, snapshots, "first", "last", "last" - "first" change, {_DIR('("last" - "first")', 'low')} direction, case when mono then 'monotonic' else 'mixed' end shape, case when snapshots < 2 then 'insufficient_history' when snapshots < 3 then 'preliminary' else 'trend' end confidence from a""",
    "delta_since_previous": f"""with {V.SNAPSHOTS}, l as (select *, lag("day") over w previous_day, quality_score - lag(quality_score) over w quality_score_delta, weak_percent - lag(weak_percent) over w weak_percent_delta, row_number() over (partition by dataset order by "day" desc) k from scores window w as (partition by dataset order by "day"))
select dataset, "day", previous_day, quality_score_delta, weak_percent_delta from l where k = 1 and previous_day is not null""",
    "failure_trends": f"""with {DENSE}, s as (select *, cast(round_even(100.0 * n / artifacts, 0) as integer) sh from dense join scores using (dataset, "day")), a as (select dataset, failure, arg_min(sh, "day") "first", arg_max(sh, "day") "last" from s group by 1, 2)
select *, "last" - "first" change, {_DIR('("last" - "first")', 'true')} direction from a""",
    "failure_changes": _CHANGES % "first",
    "failure_changes_since_previous": _CHANGES % "previous",
    "stagnant_domains": f"""with {V.SNAPSHOTS}, kinds as (select unnest([{', '.join(f"'{f}'" for f in DOMAINS)}]) failure, unnest([{', '.join(f"'{x}'" for x in DOMAINS.values())}]) domain),
s as (select d.dataset, d."day", domain, cast(round_even(100.0 * coalesce(failures, 0) / artifacts, 0) as integer) sh from (select distinct dataset, "day" from failures) d join scores using (dataset, "day") cross join kinds k
      left join failures f on f.dataset = d.dataset and f."day" = d."day" and f.failure = k.failure),
m as (select dataset, "day", domain, cast(round_even(avg(sh), 0) as integer) sh from s group by 1, 2, 3), a as (select dataset, domain, arg_min(sh, "day") "first", arg_max(sh, "day") "last", count(*) n from m group by 1, 2)
select dataset, domain, "first", "last", "last" - "first" change from a where n >= 2 and abs("last" - "first") <= 1 and "last" > 0""",
    "observed_correlations": f"""with {DENSE}, f as (select *, lag(n) over (partition by dataset, failure order by "day") - n reduction from dense), q as (select dataset, "day", quality_score - lag(quality_score) over (partition by dataset order by "day") quality_change from scores)
select dataset, "day", failure, reduction, case failure {' '.join(f"when '{k}' then '{v}'" for k, v in H.ACTIONS.items())} end "action", quality_change from f join q using (dataset, "day") where reduction > 0""",
    "capped_history": f"""with {V.SNAPSHOTS}, k as (select *, row_number() over (partition by dataset order by "day" desc) n from scores) select dataset, "day", artifacts, quality_score, weak_percent, cast(row_number() over (partition by dataset order by "day") as integer) place from k where n <= 30""",
}
