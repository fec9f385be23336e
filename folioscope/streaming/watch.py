"""Streams of publications: audit what changed, once, in the order of time."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from folioscope.operators.reports import verify_written
from folioscope.storage import shared_table


class RevisionChanges(StatefulProcessor):
    """Keeps the last revision of each issue; emits a row whenever a publication carries another one.

    Order holds within a micro-batch; equal times follow ``seq``, and a null revision is a revision like any other but is not
    remembered.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "revision string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows)).sort_values(["at", "seq"])
        known = self.last.get()[0] if self.last.exists() else None
        out = []
        for at, seq, revision in zip(whole["at"], whole["seq"], whole["revision"]):
            if revision != known:
                out.append((key[0], at, seq, revision, known))
                known = revision
        if known is not None:
            self.last.update((known,))
        yield pd.DataFrame(out, columns=["issue", "at", "seq", "revision", "previous"])

    def close(self) -> None:
        pass


class OrderedRevisionChanges(StatefulProcessor):
    """The same in order of event time across micro-batches.

    Publications are held until the watermark has passed the ``step`` of time in which they lie; then they are put in order and compared
    with the issue's last revision. An issue holds what lies within the allowed lateness, as one list. Its timer stands at the first step
    that is held; when that has passed, all that is due by then leaves at once and the timer moves on to what stays. So an issue costs a few calls
    of the state store a batch, however many publications and steps it has there.
    """

    def __init__(self, step_ms: int) -> None:
        self.step_ms = step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "revision string")
        self.held = handle.getListState("held", "ms long, at string, seq long, revision string")

    def _due(self, ms: int) -> int:
        return (ms // self.step_ms + 1) * self.step_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(ms), at, int(seq), revision) for part in rows for ms, at, seq, revision in zip(part["ms"], part["at"], part["seq"], part["revision"])]
        if fresh:
            self.held.appendList(fresh)
            self.handle.registerTimer(self._due(min(r[0] for r in fresh)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = {(ms, seq): (ms, at, seq, revision) for ms, at, seq, revision in self.held.get()}  # the last to come counts
        if not held:  # a timer before this one took all
            return iter(())
        due = sorted((r for r in held.values() if self._due(r[0]) <= until), key=lambda r: r[:3])
        known = before = self.last.get()[0] if self.last.exists() else None
        out = []
        for _, at, seq, revision in due:
            if revision != known:
                out.append((key[0], at, seq, revision, known))
                known = revision
        if known is not None and known != before:
            self.last.update((known,))
        stay = [r for r in held.values() if self._due(r[0]) > until]
        if stay:
            self.held.put(stay)
            self.handle.registerTimer(self._due(min(r[0] for r in stay)))
        else:
            self.held.clear()
        return iter([pd.DataFrame(out, columns=_CHANGE)] if out else ())

    def close(self) -> None:
        pass


_CHANGE = ["issue", "at", "seq", "revision", "previous"]
CHANGES = "issue string, at string, seq long, revision string, previous string"


def revision_changes(publications: DataFrame) -> DataFrame:
    """Streaming (issue, at, seq, revision, previous) of the publications whose revision is new for their issue.

    ``publications`` streams (issue, at, seq, revision). State is one revision per issue, without a
    timeout; it needs the RocksDB state store.
    """
    return publications.select("issue", "at", "seq", "revision").groupBy("issue").transformWithStateInPandas(RevisionChanges(), CHANGES, "Append", "None")


def ordered_revision_changes(publications: DataFrame, lateness: str = "1 hour", step_ms: int = 60_000) -> DataFrame:
    """The same changes, right also where publications come out of order over several micro-batches.

    ``publications`` streams (issue, event_time, seq, revision). A row is judged when the watermark (the latest event time less
    ``lateness``) has passed the end of its step of ``step_ms``; rows that come later than that are dropped, as of any watermark. Of
    rows of one issue, millisecond and ``seq`` the last to come counts. Rows without an event time drop out. State is
    bounded by what an issue publishes within the lateness and one step.
    """
    at = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    rows = publications.where("event_time is not null").withWatermark("event_time", lateness)
    rows = rows.select("issue", "event_time", F.unix_millis("event_time").alias("ms"), at.alias("at"), F.col("seq").cast("long").alias("seq"), "revision")
    return rows.groupBy("issue").transformWithStateInPandas(OrderedRevisionChanges(step_ms), CHANGES, "Append", "EventTime")


def late_free(runs: DataFrame, event_time: str = "event_time", key: str = "run_id", lateness: str = "1 day") -> DataFrame:
    """Each run once within the lateness allowed by event time. (Watermarks are this engine's own addition.)"""
    return runs.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key])


def watch(source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None):
    """Run ``handle`` on every micro-batch: all that is there now and then stop, or each ``interval`` for ever."""
    writer = source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, or of a table that is one file.

    The path's last letter is written as a pattern, since only a pattern may also name a single file.
    """
    path = path.rstrip("/")
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


LEDGER = "run_id string, leg string, status string, failure_stage string, batch int"


def ledger_batch(reports_path: str, ledger_path: str, legs: Mapping[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A micro-batch handler that runs every leg on the runs that the ledger does not hold as processed by it, and writes the ledger last.

    A leg takes runs and returns a row for each it could audit. Its rows are written, read back and compared; only then
    are its runs processed. A run without a row failed for want of evidence; a leg that raises fails at ``assemble``, one whose
    rows cannot be written or differ at ``persist_verify``. Failed runs are tried again when they come again, and a leg that fails
    leaves the others alone. Folders are those of batch and leg, replaced if the batch runs again.
    """

    def earlier(spark: SparkSession, batch_id: int) -> DataFrame:
        try:
            return spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("batch") != batch_id)
        except Exception as missing:  # the first batch finds no ledger
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return spark.createDataFrame([], LEDGER)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = earlier(spark, batch_id).where("status = 'processed'")
        runs = batch.dropDuplicates(["run_id"])
        for leg, audit in legs.items():
            fresh = shared_table(runs.join(known.where(F.col("leg") == leg).select("run_id"), "run_id", "left_anti"), "fresh")
            path, stage = f"{reports_path}/leg={leg}/batch={batch_id}", "assemble"
            state = fresh.select("run_id", F.lit("failed").alias("status"))
            try:
                made = shared_table(audit(fresh), "audited")
                stage = "persist_verify"
                made.write.mode("overwrite").parquet(path)
                stored = spark.read.schema(made.schema).parquet(path)
                if not verify_written(made, stored, "run_id").isEmpty():
                    raise ValueError("what was stored differs from what was made")
                done = stored.select("run_id").distinct().withColumn("_done", F.lit(True))
                stage = "evidence"
                state = fresh.join(done, "run_id", "left").select("run_id", F.when(F.col("_done"), "processed").otherwise("failed").alias("status"))
            except Exception:  # the stage goes to the ledger; the next leg runs all the same
                logging.getLogger(__name__).exception("leg %s of batch %s failed at %s", leg, batch_id, stage)
            state.withColumn("failure_stage", F.when(F.col("status") == "failed", stage)).write.mode("overwrite").parquet(f"{ledger_path}/leg={leg}/batch={batch_id}")

    return handle
