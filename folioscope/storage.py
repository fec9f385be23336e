"""Tables kept for a while in the folder that the cluster's driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task of a shuffle takes on average at most, so that a task's memory stays as it is while tables grow.
TASK_ROWS = 200_000
#: Whether a writer looks for a schema by which to split VARIANT values into columns.
SHREDDING = "spark.sql.variant.inferShreddingSchema"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where it is unset and everything runs in one process on one machine (tests), a temporary folder is made and
    remembered in that setting; on a cluster, whose machines would each see a folder of their own, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back.

    The table cuts the lineage: a lost executor costs a re-read. It stays until whoever owns the folder clears it, as
    results read it lazily. VARIANT documents are written whole: to split them into typed columns, and to put them together again at
    every read, costs more than it saves where each has a shape of its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHREDDING, None)
    if "variant" in df.schema.simpleString():
        spark.conf.set(SHREDDING, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHREDDING) if before is None else spark.conf.set(SHREDDING, before)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``keys``: over as many tasks as a shuffle has in this session, and over more where each would take more than TASK_ROWS."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *keys)
