"""Connected components of an edge table, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from folioscope.llm.common import shared_table

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for each vertex of the undirected edges (a, b); a component is its least vertex.

    Every round takes the least label among a vertex and its neighbours and then follows the label's
    own label, so path lengths at least halve. Labels are written to the shared folder each round; how many
    changed is counted while they are.
    """
    both = shared_table(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = shared_table(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        heard = both.join(labels.withColumnRenamed("v", "b"), "b").select(F.col("a").alias("v"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        stepped = heard.union(labels.select("v", "label", F.col("label").alias("old"))).groupBy("v").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("root"))
        after = stepped.join(jump, "label").select("v", F.least("label", "root").alias("label"), "old")
        seen = Observation()
        counted = after.observe(seen, F.count_if(F.col("label") != F.col("old")).alias("changed"))
        labels = shared_table(counted.select("v", "label"), "labels")
        if not seen.get["changed"]:
            return labels.select(F.col("v").alias("vertex"), F.col("label").alias("component"))
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
