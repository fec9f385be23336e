"""One row per dataset that says what to look at first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_digest(scores: DataFrame, readiness: DataFrame, leverage: DataFrame, queue: DataFrame, delta: DataFrame, changes: DataFrame, stagnant: DataFrame, items: int = 5) -> DataFrame:
    """Per dataset: quality and its change, verdict, the content failure of highest leverage, the first ``items`` of the
    priority queue, failures that came and went since the last audit, and stagnant domains.

    ``delta`` has the newest change of each dataset's metrics, ``changes`` failures with their status, ``stagnant`` domains.
    The queue is cut by its rank before it is gathered, and the other lists hold failure types or domains, so none grows with the data.
    """
    listed = lambda df, column, name: df.groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_set(column)), ",").alias(name))
    top = leverage.where("leverage_rank = 1").select("dataset", F.col("failure").alias("top_failure"), F.col("n").alias("top_failures"))
    first = queue.where(F.col("priority") <= items).groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("priority", "artifact_id"))).alias("q"))
    ids = F.array_join(F.transform("q", lambda x: x["artifact_id"].cast("string")), ",")
    out = scores.select("dataset", "quality", "artifacts")
    for part in (
        delta.select("dataset", F.col("quality_score_delta").alias("quality_delta")), readiness.select("dataset", "verdict", F.col("weaknesses")), top, first.select("dataset", ids.alias("review_first")),
        listed(changes.where("status = 'new'"), "failure", "new_failures"), listed(changes.where("status = 'resolved'"), "failure", "resolved_failures"), listed(stagnant, "domain", "stagnant_domains"),
    ):
        out = out.join(part, "dataset", "left")
    return out
