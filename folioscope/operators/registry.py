"""Publication registry: audit linkage of each issue, health, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SERIES = ("publisher", "title_group", "series")


def linkage(registry: DataFrame, audited: DataFrame, failed: DataFrame) -> DataFrame:
    """State of the current revision's audit: audited if indexed, else failed if the ledger says so, else unprocessed.

    ``audited`` and ``failed`` have one row per revision.
    """
    marked = registry.join(audited.select("revision", F.lit(True).alias("_a")), "revision", "left").join(failed.select("revision", "failure_stage", F.lit(True).alias("_f")), "revision", "left")
    state = F.when(F.col("revision").isNull(), "no_revision").when(F.col("_a"), "audited").when(F.col("_f"), "failed").otherwise("unprocessed")
    return marked.select(*registry.columns, state.alias("linked_state"), F.when(state == "failed", F.col("failure_stage")).alias("failure_stage"))


def issue_health(registry: DataFrame) -> DataFrame:
    """unknown without a revision; attention with reasons; else healthy."""
    reasons = F.concat_ws(
        ",",
        F.when(F.col("state") != "platform_approved", "not_platform_approved"),
        F.when(F.col("audit_state") == "failed", "audit_failed"),
        F.when(F.col("audit_state") == "unprocessed", "audit_pending"),
    )
    none = F.col("revision").isNull()
    return registry.withColumn("reasons", F.when(none, "no_published_revision").otherwise(reasons)).withColumn(
        "health", F.when(none, "unknown").when(reasons != "", "attention").otherwise("healthy")
    )


def _verdict(attention, healthy, total):
    return F.when(attention > 0, "attention").when((healthy == total) & (total > 0), "healthy").otherwise("unknown")


def series_health(issues: DataFrame) -> DataFrame:
    """Per series: issues by health; any attention is attention, all healthy is healthy, else unknown."""
    out = issues.groupBy(*SERIES).agg(F.count("*").alias("issues"), *[F.count_if(F.col("health") == h).alias(h) for h in ("healthy", "attention", "unknown")])
    return out.withColumn("health", _verdict(F.col("attention"), F.col("healthy"), F.col("issues")))


def publisher_health(series: DataFrame) -> DataFrame:
    """Per publisher: the same over its series, which gives what the issues themselves would give."""
    out = series.groupBy("publisher").agg(
        F.count("*").alias("series_count"), *[F.sum(c).alias(c) for c in ("issues", "healthy", "attention", "unknown")], F.count_if(F.col("health") == "attention").alias("series_in_attention")
    )
    return out.withColumn("health", _verdict(F.col("attention"), F.col("healthy"), F.col("issues")))


def cross_series_health(series: DataFrame) -> DataFrame:
    """The attention set: every series that is not healthy (unknown ones too), with its counts of issues."""
    return series.where("health <> 'healthy'").select(*SERIES, "health", "issues", "healthy", "attention", "unknown")


def series_summary(series: DataFrame) -> DataFrame:
    """Series of the whole platform by health, and their issues."""
    return series.groupBy("health").agg(F.count("*").alias("series_count"), F.sum("issues").alias("issues"))


def rollup(registry: DataFrame) -> DataFrame:
    """Issues at each level of the hierarchy; null marks a level that is summed over."""
    return registry.rollup(*SERIES).agg(F.count("*").alias("issues"), F.count("revision").alias("published"), F.grouping_id().alias("level_bits"))


def members(registry: DataFrame) -> DataFrame:
    """One row per level, group and issue: which issues lie in each publisher, title group and series.

    Groups are those of one level's name alone, so a title group or series that several publishers have is one group. As rows
    a group may hold any number of issues.
    """
    levels = F.array(*[F.struct(F.lit(s).alias("level"), F.col(s).cast("string").alias("value")) for s in SERIES])
    return registry.select(F.inline(levels), F.concat_ws("/", *SERIES, F.col("issue").cast("string")).alias("issue_path"))


def tree(registry: DataFrame) -> DataFrame:
    """The nesting of publishers, title groups, series and issues, a row per node: path, parent's path, level, name, children, issues.

    Issues below a node are summed up level by level.
    """
    names = (*SERIES, "issue")
    path = lambda k: F.concat_ws("/", *[F.col(n).cast("string") for n in names[:k]])
    nodes = registry.groupBy(*names).agg(F.lit(0).cast("long").alias("children"), F.lit(1).cast("long").alias("issues"))
    out = None
    for k in range(len(names), 0, -1):
        part = nodes.select(path(k).alias("path"), (path(k - 1) if k > 1 else F.lit(None).cast("string")).alias("parent"), F.lit(names[k - 1]).alias("level"), F.col(names[k - 1]).cast("string").alias("name"), "children", "issues")
        out = part if out is None else out.unionByName(part)
        nodes = nodes.groupBy(*names[: k - 1]).agg(F.count("*").alias("children"), F.sum("issues").alias("issues")) if k > 1 else nodes
    return out
