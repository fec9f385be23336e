"""Tables kept by key: a load rewrites the buckets of the keys that it brings, and no other."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.reports import upsert
from folioscope.storage import shared_table

#: Buckets of a table whose maker does not say; a bucket is what one task rewrites.
BUCKETS = 256


class KeyedTable:
    """A Parquet table in buckets by the hash of its key, brought up to date load by load.

    ``schema`` is that of its rows. Loads are numbered in ascending order; a bucket remembers the last load that it has seen, so a
    load that broke off half way may simply be run again: what it had written before is left alone. Null keys are keys.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], schema: T.StructType | str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, list(key), buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        whole = T.StructType([*self.schema.fields, T.StructField("_load", T.LongType()), T.StructField("_bucket", T.IntegerType())])
        try:
            return self.spark.read.schema(whole).parquet(self.path)
        except Exception as missing:  # nothing has been loaded yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], whole)

    def read(self) -> DataFrame:
        return self._stored().select(*self.schema.fieldNames())

    def load(self, fresh: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Bring ``fresh`` in by ``merge(stored, fresh)``, which sees whole keys; returns the buckets that were rewritten.

        Only the stored rows of these buckets are read. Their numbers are all that the driver gets.
        """
        names = self.schema.fieldNames()
        dealt = shared_table(fresh.withColumn("_bucket", self._bucket()), "load")
        wanted = sorted(r["_bucket"] for r in dealt.select("_bucket").distinct().collect())
        stored = self._stored().where(F.col("_bucket").isin(wanted)) if wanted else self._stored().limit(0)
        seen = {r["_bucket"] for r in stored.groupBy("_bucket").agg(F.max("_load").alias("n")).where(F.col("n") >= number).collect()}
        todo = [b for b in wanted if b not in seen]
        if not todo:
            return []
        old = stored.where(F.col("_bucket").isin(todo))
        new = dealt.where(F.col("_bucket").isin(todo)).drop("_bucket")
        merged = merge(old.select(*names), new).select(*names).withColumn("_load", F.lit(number).cast("long")).withColumn("_bucket", self._bucket())
        ready = shared_table(merged, "merged")  # what is read is about to be replaced
        ready.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        return todo


def keep_latest(key: Sequence[str], order: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps of each key the row of greatest ``order``, a fresh one before a stored one of equal order."""
    return lambda stored, fresh: upsert(stored, fresh, key, order)


#: What is known of all attempts at a revision under one methodology.
LEDGER_STATE = (
    "revision long, fingerprint string, attempts long, first_seen string, updated_at string, "
    "last struct<at:string,attempt:long,status:string,failure_stage:string>"
)
_LEDGER_KEY = ("revision", "fingerprint")


def ledger_of(attempts: DataFrame) -> DataFrame:
    """The state that some attempts amount to: how many, when first and last, and the last one; of equal times the greatest attempt."""
    one = F.struct("at", F.col("attempt").cast("long").alias("attempt"), "status", "failure_stage")
    return attempts.groupBy(F.col("revision").cast("long").alias("revision"), "fingerprint").agg(
        F.count("*").alias("attempts"), F.min("at").alias("first_seen"), F.max("at").alias("updated_at"), F.max(one).alias("last"),
    )


def fold_ledger(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Two states as one: it does not matter how the attempts were split, nor in what order the parts come."""
    return stored.unionByName(fresh).groupBy(*_LEDGER_KEY).agg(
        F.sum("attempts").alias("attempts"), F.min("first_seen").alias("first_seen"), F.max("updated_at").alias("updated_at"), F.max("last").alias("last"),
    )


def ledger_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(spark, path, _LEDGER_KEY, LEDGER_STATE, buckets)


def ledger_rows(state: DataFrame) -> DataFrame:
    """The state as it is reported; success clears the failure."""
    failed = F.when(F.col("last.status") != "processed", F.col("last.failure_stage"))
    return state.select(*_LEDGER_KEY, "attempts", "first_seen", "updated_at", "last.status", failed.alias("failure_stage"))
