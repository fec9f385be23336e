"""Streams over the driver's events, run to the end of what is there and read back."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import functions as F

from folioscope.plans import views as V
from folioscope.storage import shared_folder
from folioscope.streaming import watch as W


def _events(spark, d):
    path = f"{d}/events.parquet"
    return W.file_stream(spark, path, spark.read.parquet(path).schema)


def _folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_revision_changes(spark, d):
    """Publications (an event of a user) whose revision (the event's type) differs from the user's last one."""
    name, folder = "spark.sql.streaming.stateStore.providerClass", _folder(spark)
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        publications = _events(spark, d).select(
            F.col("user_id").cast("string").alias("issue"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("revision")
        )
        changes = W.revision_changes(publications)
        changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(W.CHANGES).parquet(f"{folder}/out").select("issue", "seq", "revision", "previous")


#: How late an event may be, and the step in which events are put in order.
LATENESS, STEP_MS = "2 days", 6 * 3_600_000


def stream_ordered_changes(spark, d):
    """The same by event time: what is settled when the stream has been read, two days and a step before its latest event."""
    name, folder = "spark.sql.streaming.stateStore.providerClass", _folder(spark)
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        publications = _events(spark, d).select(
            F.col("user_id").cast("string").alias("issue"), F.col("ts").cast("timestamp").alias("event_time"), F.col("event_id").alias("seq"), F.col("event_type").alias("revision")
        )
        changes = W.ordered_revision_changes(publications, LATENESS, STEP_MS)
        changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(W.CHANGES).parquet(f"{folder}/out").select("issue", "seq", "revision", "previous")


def stream_ledger(spark, d):
    """Runs (user and day) audited by two legs, by way of the ledger: the delta leg finds no evidence for every thirteenth
    user, and a third leg breaks down. What the ledger holds in the end."""
    folder = _folder(spark)
    runs = _events(spark, d).select(F.concat_ws("@", F.col("user_id").cast("string"), V.day(F.col("ts"))).alias("run_id"), "user_id", "value")

    def broken(fresh):
        raise ValueError("no such leg")

    legs = {"dataset": lambda fresh: fresh.select("run_id"), "delta": lambda fresh: fresh.where("user_id % 13 <> 0").select("run_id"), "broken": broken}
    logging.getLogger("folioscope.streaming.watch").setLevel(logging.CRITICAL)  # the broken leg is meant to break
    W.watch(runs, W.ledger_batch(f"{folder}/reports", f"{folder}/ledger", legs), f"{folder}/state").awaitTermination()
    return spark.read.schema(W.LEDGER).parquet(f"{folder}/ledger").select("run_id", "leg", "status", "failure_stage")


def stream_late_free(spark, d):
    """Runs once each, however often they are published within the allowed lateness."""
    folder = _folder(spark)
    runs = _events(spark, d).select(F.concat_ws("@", F.col("user_id").cast("string"), V.day(F.col("ts"))).alias("run_id"), F.col("ts").cast("timestamp").alias("event_time"))
    W.late_free(runs, lateness="40 days").select("run_id").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("run_id string").parquet(f"{folder}/out")


QUERIES = [stream_revision_changes, stream_ordered_changes, stream_ledger, stream_late_free]

ORACLES = {
    "stream_revision_changes": """with l as (select user_id::varchar issue, event_id seq, event_type revision, lag(event_type) over (partition by user_id order by strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), event_id) previous from events)
select * from l where previous is null or previous <> revision""",
    "stream_ordered_changes": f"""with e as (select *, epoch_ms(ts) ms from events), w as (select max(ms) - 2 * 86400000 mark from e),
due as (select e.* from e, w where (ms // {STEP_MS} + 1) * {STEP_MS} <= mark),
l as (select user_id::varchar issue, event_id seq, event_type revision, lag(event_type) over (partition by user_id order by ms, event_id) previous from due) select * from l where previous is null or previous <> revision""",
    "stream_ledger": """with r as (select distinct user_id, user_id || '@' || strftime(ts, '%Y-%m-%d') run_id from events)
select run_id, 'dataset' leg, 'processed' status, cast(null as varchar) failure_stage from r union all select run_id, 'broken', 'failed', 'assemble' from r
union all select run_id, 'delta', case when user_id % 13 <> 0 then 'processed' else 'failed' end, case when user_id % 13 = 0 then 'evidence' end from r""",
    "stream_late_free": "select distinct user_id || '@' || strftime(ts, '%Y-%m-%d') run_id from events",
}
