"""Derived tables that are rebuilt from what lies below them, replaced as a whole and read back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.reports import verify_written
from folioscope.storage import shared_table


def rebuild(spark: SparkSession, folder: str, projections: Mapping[str, tuple[DataFrame, str, Sequence[str]]], generated_at: str) -> DataFrame:
    """Write each projection (its rows, the column to partition by, its key) below ``folder`` and compare what can be read.

    All carry the one time of this rebuild. One that fails leaves the others alone and is told by its status, so that no
    stale table passes for a fresh one. Returns (projection, status).
    """
    done = []
    for name, (rows, partition, key) in projections.items():
        path = f"{folder}/{name}"
        try:
            made = rows.withColumn("generated_at", F.lit(generated_at)).withColumn("_key", F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key]))
            made = shared_table(made, "projection")  # made once: it is written and compared with what is read back
            # a task sorts its rows by partition before it writes them; rebalanced, it holds no more for a larger table
            made.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(path)
            stored = spark.read.schema(made.schema).parquet(path)
            wrong = not verify_written(made, stored, "_key").isEmpty()
            done.append((name, "differs" if wrong else "rebuilt"))
        except Exception as failure:  # recorded; the other projections are rebuilt all the same
            done.append((name, f"failed: {type(failure).__name__}"))
    return spark.createDataFrame(done, "projection string, status string")
