"""Count-weighted benchmarks over the publisher hierarchy, separated wherever the measuring method changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.columns import axes_key, changed_axes, rate
from folioscope.operators.ordered import placed, ranked, settled, with_previous, with_running_sum
from folioscope.storage import shared_table

PLACE = ("publisher", "title_group", "series", "issue")
#: Level of the hierarchy -> the keys that make it up.
LEVELS: Mapping[str, Sequence[str]] = {"issue": PLACE, "series": PLACE[:3], "publisher": PLACE[:1], "platform": ()}
#: Failure modes, and what is recommended beyond which rate of one.
FAILURE_MODES = ("panel_splits", "panel_merges", "false_panels", "missing_page_panels", "spread_missing_panels")
RECOMMENDATIONS: Mapping[str, tuple[float, str]] = {"panel_merges": (0.5, "geometry.under_segmentation"), "false_panels": (0.15, "geometry.precision_gap")}


# The versions of this audit's own methods, which are axes of what may be compared.
METHODS = {
    "metric_definition_version": "v1", "geometry_detector_version": "v2", "iou_threshold": "0.5", "normalization_version": "v1",
    "metadata_revision_distance_version": "v1", "metadata_accuracy_version": "v3", "evaluation_version": "v2",
}
# The axes of either task.
GEOMETRY_AXES = ("task", "metric_definition_version", "geometry_detector_version", "iou_threshold", "normalization_version")
METADATA_AXES = (
    "task", "metric_definition_version", "metadata_prompt_version", "metadata_prompt_sha256", "metadata_model", "metadata_schema_version",
    "metadata_revision_distance_version", "metadata_accuracy_version", "normalization_version", "evaluation_version",
)


def comparability(reviews: DataFrame, generators: DataFrame, methods: Mapping[str, str] = METHODS) -> DataFrame:
    """``reviews`` with all axes of both tasks and the comparability key of each.

    ``reviews`` and ``generators`` are those of an adapted record. The axes of a task depend on the versions of the audit's ``methods``;
    those of metadata also on who made it (a mix has an axis value of its own) and on both sides' schema versions. A changed
    axis changes the key, so that nothing is joined to one series that was not measured alike.
    """
    schemas = F.concat_ws("/", F.coalesce("generated_metadata_version", F.lit("None")), F.coalesce("approved_metadata_version", F.lit("None")))
    told = {"metadata_prompt_version": F.col("prompt_version"), "metadata_prompt_sha256": F.col("prompt_sha256"), "metadata_model": F.col("model"), "metadata_schema_version": schemas}
    value = lambda task, axis: F.lit(task) if axis == "task" else told.get(axis, F.lit(methods.get(axis)))
    rows = reviews.join(generators.select("review_key", "model", "prompt_version", "prompt_sha256"), "review_key", "left")
    for task, axes in (("geometry", GEOMETRY_AXES), ("metadata", METADATA_AXES)):
        of = {a: value(task, a) for a in axes}
        rows = rows.withColumn(f"{task}_axes", F.struct(*[c.cast("string").alias(a) for a, c in of.items()]))
        rows = rows.withColumn(f"{task}_comparability_key", axes_key("cmp", of))
    return rows.drop("model", "prompt_version", "prompt_sha256")


def keyed(reports: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Adds the comparability key: reports with different keys are never added up."""
    return reports.withColumn("comparability_key", axes_key("cmp", {a: F.col(a) for a in axes}))


def points(reports: DataFrame, metrics: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row per report and metric with numerator and denominator; none where the denominator is null.

    ``metrics`` maps a metric's name to its numerator's and denominator's column.
    """
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(n).cast("long").alias("num"), F.col(d).cast("long").alias("den")) for m, (n, d) in metrics.items()])
    used = {c for pair in metrics.values() for c in pair}
    return reports.select(*[c for c in reports.columns if c not in used], F.inline(rows)).where("den is not null")


def segments(pts: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Sums of numerators over sums of denominators per scope, key and metric; never a mean of rates."""
    out = pts.groupBy(*scope, "comparability_key", "metric").agg(F.sum("num").alias("numerator"), F.sum("den").alias("denominator"), F.count("*").alias("reports"))
    return out.withColumn("value", rate(F.col("numerator"), F.col("denominator"), None))


def hierarchy(pts: DataFrame) -> DataFrame:
    """The segments of all levels at once, of points."""
    return _levels(pts.groupBy(*PLACE, "comparability_key", "metric").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.count("*").alias("n")))


def hierarchy_of_reports(reports: DataFrame, metrics: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``hierarchy(points(reports, metrics))``, with all metrics of an issue summed side by side before they become rows.

    An issue has few reports under one key, so points would go to the shuffle nearly as they are, one row for each metric.
    """
    name = lambda kind, m: f"_{kind}_{m}"
    sums = []
    for m, (num, den) in metrics.items():
        there = F.col(den).cast("long")
        sums += [F.sum(F.when(there.isNotNull(), F.col(num).cast("long"))).alias(name("num", m)), F.sum(there).alias(name("den", m)), F.count(there).alias(name("n", m))]
    wide = reports.groupBy(*PLACE, "comparability_key").agg(*sums)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(name(kind, m)).alias(kind) for kind in ("num", "den", "n")]) for m in metrics])
    return _levels(wide.select(*PLACE, "comparability_key", F.inline(rows)).where("n > 0"))


def _levels(issues: DataFrame) -> DataFrame:
    """All levels from sums per issue, key and metric (num, den, n).

    They are stored, since two reads follow, and summed per series; the levels above are grouping sets over those sums, where a row is one series already.
    """
    issues = shared_table(issues, "issues")
    # summed by series next, so that the levels above count series as rows and need no distinct count
    per_issue = issues.select(*PLACE, "comparability_key", "metric", "num", "den", "n", F.lit(1).cast("long").alias("issues"), F.lit("issue").alias("level"))
    series = issues.groupBy(*PLACE[:3], "comparability_key", "metric").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("n").alias("n"), F.count("*").alias("issues"))
    upper = [[*LEVELS[level], "comparability_key", "metric"] for level in ("series", "publisher", "platform")]
    sums = series.groupingSets(upper, *PLACE[:3], "comparability_key", "metric").agg(
        F.grouping_id().alias("bits"), F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("n").alias("n"), F.sum("issues").alias("issues"), F.count("*").alias("series_count")
    )
    level = F.when(F.col("bits") == 0b00000, "series").when(F.col("bits") == 0b01100, "publisher").otherwise("platform")
    sums = sums.withColumn("issue", F.lit(None).cast(issues.schema["issue"].dataType)).withColumn("level", level).drop("bits")
    out = per_issue.withColumn("series_count", F.lit(1).cast("long")).unionByName(sums)
    out = out.withColumnsRenamed({"num": "numerator", "den": "denominator", "n": "reports"})
    return out.withColumn("value", rate(F.col("numerator"), F.col("denominator"), None))


def series_boundaries(reports: DataFrame, scope: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Reports of a scope in order of their run: whether the method changed, in which axes, and the segment's number."""
    names = {f"_was_{a}": a for a in (*axes, "comparability_key")}
    rows = with_previous(placed(reports, scope, [F.col("run_seq")]), scope, names)
    change = F.col("_has_previous") & ~F.col("comparability_key").eqNullSafe(F.col("_was_comparability_key"))
    moved = changed_axes({a: F.col(a) for a in axes}, {a: F.col(f"_was_{a}") for a in axes})
    out = rows.withColumn("changed", change).withColumn("changed_axes", F.when(F.col("changed"), moved).otherwise(""))
    out = shared_table(out.drop(*names), "changes")  # two reads follow
    return settled(with_running_sum(out, scope, F.col("changed").cast("int"), "segment"))


def dual_time(reports: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Place of each report by event time and by measurement time, then by run; a null time comes first."""
    by = lambda c: [F.coalesce(c, F.lit("")), F.coalesce("run_seq", F.lit(0))]
    both = ranked(ranked(reports, scope, by("event"), "event_place"), scope, by("measured"), "measured_place")
    return both.withColumn("late", F.col("event_place") < F.col("measured_place"))


def failure_modes(pts: DataFrame, scope: Sequence[str], modes: Sequence[str] = FAILURE_MODES) -> DataFrame:
    """Geometry failure modes per segment, most frequent first; a rate over nothing is 0.0.

    Each mode is a metric of the points, with its own denominator (approved or generated panels).
    """
    out = pts.where(F.col("metric").isin(*modes) & F.col("comparability_key").isNotNull()).groupBy(*scope, "comparability_key", "metric").agg(F.sum("num").alias("failures"), F.sum("den").alias("of"))
    order = Window.partitionBy(*scope, "comparability_key").orderBy(F.desc("failures"), "metric")
    return out.withColumn("rate", rate(F.col("failures"), F.col("of"))).withColumn("rank", F.row_number().over(order))


def recommendations(modes: DataFrame, rules: Mapping[str, tuple[float, str]] = RECOMMENDATIONS) -> DataFrame:
    """One row for each recommendation that a segment's failure modes call for, with the rate as evidence."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(float(limit)).alias("limit"), F.lit(code).alias("code")) for m, (limit, code) in rules.items()])
    due = F.filter(rows, lambda r: (r["metric"] == F.col("metric")) & (F.col("rate") > r["limit"]))
    return modes.select(*[c for c in modes.columns if c != "code"], F.explode(F.transform(due, lambda r: r["code"])).alias("code"))


def version_improvements(pts: DataFrame, scope: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Segments of a scope by their first measurement, with the change of each metric from the one before."""
    seg = pts.groupBy(*scope, "comparability_key", *axes, "metric").agg(F.min(F.struct("measured", "run_seq")).alias("started"), F.sum("num").alias("numerator"), F.sum("den").alias("denominator"))
    seg = seg.withColumn("value", rate(F.col("numerator"), F.col("denominator"), None))
    order = Window.partitionBy(*scope, "metric").orderBy("started", "comparability_key")
    before = {a: F.lag(a).over(order) for a in axes}
    out = seg.withColumn("previous", F.lag("value").over(order)).withColumn("changed_axes", changed_axes({a: F.col(a) for a in axes}, before))
    return out.where(F.col("previous").isNotNull()).withColumn("delta", F.bround(F.col("value") - F.col("previous"), 6)).withColumn("since", F.col("started.measured")).drop("started")


def correlation(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Acceptance by combination of keys; nulls group."""
    out = rows.groupBy(*by).agg(F.count("*").alias("reports"), F.sum("num").alias("accepted"), F.sum("den").alias("comparable"))
    return out.withColumn("acceptance", rate(F.col("accepted"), F.col("comparable"), None))


def series_comparison(pts: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per series the figures of the method of its newest run, and how many methods it has seen."""
    scope = list(PLACE[:3])
    newest = pts.groupBy(*scope).agg(F.max(F.struct("run_seq", "comparability_key")).alias("last"), F.countDistinct("comparability_key").alias("methods"))
    newest = newest.select(*scope, F.col("last.comparability_key").alias("comparability_key"), "methods")
    seg = segments(pts.where(F.col("metric").isin(*metrics)), scope).join(newest, [*scope, "comparability_key"])
    wide = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    return seg.groupBy(*scope, "comparability_key", "methods").agg(*wide, F.max("reports").alias("reports")).withColumn("several_methods", F.col("methods") > 1)


def compare_series(tasks: Mapping[str, tuple[DataFrame, Sequence[str]]], health: DataFrame) -> DataFrame:
    """Series side by side: of each task the figures of its newest run's method and how many methods it has seen, and the health.

    ``tasks`` maps a task's name to its points and metrics; tasks are keyed apart, so one may have changed its method where another has not
    (``<task>_several_methods``). ``health`` has a row per series (publisher, title group and series together); one without any
    benchmark stays, with nulls.
    """
    scope = list(PLACE[:3])
    out = health
    for task, (pts, metrics) in tasks.items():
        part = series_comparison(pts, metrics)
        names = {c: f"{task}_{c}" for c in ("comparability_key", "methods", "reports", "several_methods")}
        out = out.join(part.withColumnsRenamed(names), scope, "left")
    return out


#: Fields edited more often than this are worth a look at the prompt.
REWORK = 0.4


def prompt_refinements(weak: DataFrame, most: float = REWORK) -> DataFrame:
    """The weak fields whose rate of edits says that the prompt might be refined, with the advice; nothing is changed by it."""
    found = weak.where((F.col("edit_rate") > most) & (F.col("comparable") > 0))
    return found.select("field", "edit_rate", F.lit("high editorial rework").alias("reason"), F.lit("metadata.prompt_refinement").alias("code"))


def scope_filter(entries: DataFrame, level: str, root: str, path: str = "path") -> DataFrame:
    """Entries at a scope's root or below it; all for the platform. A longer name that merely begins alike is outside."""
    if level == "platform":
        return entries
    return entries.where((F.col(path) == root) | F.col(path).startswith(root.rstrip("/") + "/"))
