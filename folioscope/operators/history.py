"""Audit history: trends, changes since the audit before, failures that came and went."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.columns import percent

STABLE, CAP = 1, 30
#: The failure whose reduction suggests an action.
ACTIONS: Mapping[str, str] = {
    "unreviewed": "reviews_performed", "not_approved": "approvals_performed", "not_locked": "locks_performed", "missing_characters": "characters_added",
    "missing_dialogue": "dialogue_added", "missing_metadata": "metadata_completed", "unpaged": "page_links_added", "status_incomplete": "enrichment_completed",
}


def direction(change: Column, lower_is_better: bool) -> Column:
    better = change < 0 if lower_is_better else change > 0
    return F.when(F.abs(change) <= STABLE, "stable").when(better, "improving").otherwise("worsening")


def trends(scores: DataFrame, metrics: Mapping[str, bool]) -> DataFrame:
    """Per dataset and metric: first, last, change, direction, shape, confidence.

    ``metrics`` tells of each metric whether lower is better. One snapshot is no history, two are preliminary.
    """
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(low).alias("lower")) for m, low in metrics.items()])
    long = scores.select("dataset", "day", F.inline(rows))
    order = Window.partitionBy("dataset", "metric").orderBy("day")
    stepped = long.withColumn("step", F.col("value") - F.lag("value").over(order))
    out = stepped.groupBy("dataset", "metric", "lower").agg(
        F.count("*").alias("snapshots"), F.min_by("value", "day").alias("first"), F.max_by("value", "day").alias("last"),
        F.coalesce(F.bool_and(F.col("step") >= 0), F.lit(True)).alias("up"), F.coalesce(F.bool_and(F.col("step") <= 0), F.lit(True)).alias("down"),
    )
    change = F.col("last") - F.col("first")
    turn = F.when(F.col("lower"), direction(change, True)).otherwise(direction(change, False))
    confidence = F.when(F.col("snapshots") < 2, "insufficient_history").when(F.col("snapshots") < 3, "preliminary").otherwise("trend")
    return out.select("dataset", "metric", "snapshots", "first", "last", change.alias("change"), turn.alias("direction"), F.when(F.col("up") | F.col("down"), "monotonic").otherwise("mixed").alias("shape"), confidence.alias("confidence"))


def since_previous(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The newest snapshot of each dataset with its change of every metric; none for a first snapshot."""
    order = Window.partitionBy("dataset").orderBy("day")
    newest = Window.partitionBy("dataset").orderBy(F.desc("day"))
    out = scores.withColumn("previous_day", F.lag("day").over(order)).withColumn("_n", F.row_number().over(newest))
    for m in metrics:
        out = out.withColumn(f"{m}_delta", F.col(m) - F.lag(m).over(order))
    return out.where("_n = 1 and previous_day is not null").select("dataset", "day", "previous_day", *[f"{m}_delta" for m in metrics])


def dense_failures(failures: DataFrame) -> DataFrame:
    """(dataset, day, failure, failures) with zeros: every type a dataset ever had on each day that carries failure data."""
    days, kinds = failures.select("dataset", "day").distinct(), failures.select("dataset", "failure").distinct()
    return days.join(kinds, "dataset").join(failures, ["dataset", "day", "failure"], "left").fillna(0, ["failures"])


def failure_trends(failures: DataFrame, scores: DataFrame) -> DataFrame:
    """Per dataset and failure: share of artifacts at first and last, and the change."""
    shares = dense_failures(failures).join(scores.select("dataset", "day", "artifacts"), ["dataset", "day"]).withColumn("share", percent(F.col("failures"), F.col("artifacts")))
    out = shares.groupBy("dataset", "failure").agg(F.min_by("share", "day").alias("first"), F.max_by("share", "day").alias("last"))
    change = F.col("last") - F.col("first")
    return out.select("*", change.alias("change"), direction(change, True).alias("direction"))


def _edges(failures: DataFrame, newest: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Failure types of the last day with failure data, those of the day to compare with, and the datasets with two such days."""
    days = failures.select("dataset", "day").distinct()
    latest = days.withColumn("_n", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("day"))))
    able = latest.where("_n = 2").select("dataset")
    first = latest.where("_n = 2") if newest else days.groupBy("dataset").agg(F.min("day").alias("day"))
    of = lambda d: failures.where("failures > 0").join(d.select("dataset", "day"), ["dataset", "day"]).select("dataset", "failure")
    return of(latest.where("_n = 1")), of(first), able


def new_and_resolved(failures: DataFrame, newest: bool = False) -> DataFrame:
    """Failure types that the last snapshot has and the first had not (new), and the reverse (resolved).

    With ``newest`` the last snapshot is compared with the one before it instead. Only snapshots that carry failure data count.
    """
    keys = ["dataset", "failure"]
    last, before, able = _edges(failures, newest)
    new = last.join(before, keys, "left_anti").join(able, "dataset").withColumn("status", F.lit("new"))
    return new.unionByName(before.join(last, keys, "left_anti").join(able, "dataset").withColumn("status", F.lit("resolved")))


def failure_deltas(failures: DataFrame, scores: DataFrame) -> DataFrame:
    """Per dataset and failure type: share of artifacts in the last two snapshots that carry failure data, the change, and whether it is new or resolved.

    A type that one of the two lacks counts as 0 there; one that both lack is left out. Datasets with a single such snapshot have no rows.
    """
    days = failures.select("dataset", "day").distinct()
    last = days.withColumn("_n", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("day")))).where("_n <= 2")
    both = last.join(last.where("_n = 2").select("dataset"), "dataset").join(scores.select("dataset", "day", "artifacts"), ["dataset", "day"], "left")
    rows = failures.where("failures > 0").join(both, ["dataset", "day"])
    side = lambda n, value: F.coalesce(F.max(F.when(F.col("_n") == n, value)), F.lit(0))
    share = percent(F.col("failures"), F.coalesce("artifacts", F.lit(0)))
    out = rows.groupBy("dataset", "failure").agg(side(2, share).alias("before"), side(1, share).alias("now"), F.count_if(F.col("_n") == 2).alias("_b"), F.count_if(F.col("_n") == 1).alias("_a"))
    status = F.when(F.col("_b") == 0, "new").when(F.col("_a") == 0, "resolved").otherwise("known")
    return out.select("dataset", "failure", "before", "now", (F.col("now") - F.col("before")).alias("delta"), status.alias("status"))


def stagnant_domains(failures: DataFrame, scores: DataFrame, domains: Mapping[str, str]) -> DataFrame:
    """Domains whose mean share of failures has hardly moved between the first and the last snapshot and is above 0.

    ``domains`` names each failure type's domain; a type that a snapshot lacks counts as 0 there.
    """
    kinds = F.array(*[F.struct(F.lit(f).alias("failure"), F.lit(d).alias("domain")) for f, d in domains.items()])
    days = failures.select("dataset", "day").distinct().join(scores.select("dataset", "day", "artifacts"), ["dataset", "day"])
    shares = days.select("*", F.inline(kinds)).join(failures, ["dataset", "day", "failure"], "left").withColumn("share", percent(F.coalesce("failures", F.lit(0)), F.col("artifacts")))
    means = shares.groupBy("dataset", "day", "domain").agg(F.bround(F.avg("share"), 0).cast("int").alias("share"))
    out = means.groupBy("dataset", "domain").agg(F.count("*").alias("days"), F.min_by("share", "day").alias("first"), F.max_by("share", "day").alias("last")).where("days >= 2")
    change = F.col("last") - F.col("first")
    return out.where((F.abs(change) <= STABLE) & (F.col("last") > 0)).select("dataset", "domain", "first", "last", change.alias("change"))


def observed_correlations(failures: DataFrame, scores: DataFrame, actions: Mapping[str, str] = ACTIONS) -> DataFrame:
    """Reductions of a failure between neighbouring snapshots, the action they suggest and the quality's change."""
    order = Window.partitionBy("dataset", "failure").orderBy("day")
    by_day = Window.partitionBy("dataset").orderBy("day")
    quality = scores.select("dataset", "day", (F.col("quality_score") - F.lag("quality_score").over(by_day)).alias("quality_change"))
    fell = dense_failures(failures).withColumn("reduction", F.lag("failures").over(order) - F.col("failures")).where("reduction > 0")
    action = F.try_element_at(F.create_map(*[F.lit(x) for pair in actions.items() for x in pair]), F.col("failure"))
    return fell.join(quality, ["dataset", "day"]).select("dataset", "day", "failure", "reduction", action.alias("action"), "quality_change").where("action is not null")


def capped(scores: DataFrame, fresh: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """The newest ``cap`` snapshots of each dataset, in order of time."""
    whole = scores if fresh is None else scores.unionByName(fresh, allowMissingColumns=True)
    order = Window.partitionBy("dataset").orderBy(F.desc("day"))
    kept = whole.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy("day")))
