import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from folioscope.streaming import watch as W

RUNS = "run_id string, event_time timestamp"


def write(spark, folder, rows):
    spark.createDataFrame(rows, "run_id string, t string").select("run_id", F.to_timestamp("t").alias("event_time")).coalesce(1).write.mode("append").parquet(folder)


def test_ledger_makes_each_run_once(spark, tmp_path):
    source, reports, ledger = (str(tmp_path / n) for n in ("in", "reports", "ledger"))
    handle = W.ledger_batch(reports, ledger, {"delta": lambda fresh: fresh.select("run_id", F.lit(1).alias("score"))})
    schema = spark.createDataFrame([], RUNS).schema
    write(spark, source, [("a", "2020-01-01"), ("a", "2020-01-01"), ("b", "2020-01-02")])
    for _ in range(2):
        W.watch(W.file_stream(spark, source, schema, 1), handle, str(tmp_path / "state")).awaitTermination()
    write(spark, source, [("b", "2020-01-02"), ("c", "2020-01-03")])
    W.watch(W.file_stream(spark, source, schema, 1), handle, str(tmp_path / "state")).awaitTermination()
    assert sorted(r["run_id"] for r in spark.read.parquet(ledger).collect()) == ["a", "b", "c"]
    assert sorted(r["run_id"] for r in spark.read.parquet(reports).collect()) == ["a", "b", "c"]


def test_a_batch_that_failed_half_way_is_repaired(spark, tmp_path):
    reports, ledger = str(tmp_path / "reports"), str(tmp_path / "ledger")
    rows = spark.createDataFrame([("a",), ("b",)], "run_id string")
    rows.limit(1).write.parquet(f"{reports}/leg=delta/batch=0")  # reports of a batch whose ledger was never written
    handle = W.ledger_batch(reports, ledger, {"delta": lambda fresh: fresh})
    for batch in (0, 0, 1):
        handle(rows, batch)
    assert sorted(r["run_id"] for r in spark.read.parquet(reports).collect()) == ["a", "b"]
    assert {(r["run_id"], r["batch"]) for r in spark.read.parquet(ledger).where("batch = 0").collect()} == {("a", 0), ("b", 0)}


def test_legs_fail_apart_and_are_tried_again(spark, tmp_path):
    reports, ledger = str(tmp_path / "reports"), str(tmp_path / "ledger")
    rows = spark.createDataFrame([("a",), ("b",)], "run_id string")
    able = {"now": False}

    def shaky(fresh):
        if not able["now"]:
            raise ValueError("not yet")
        return fresh

    handle = W.ledger_batch(reports, ledger, {"shaky": shaky, "partial": lambda fresh: fresh.where("run_id = 'a'"), "whole": lambda fresh: fresh})
    state = lambda: {(r["leg"], r["run_id"], r["batch"]): (r["status"], r["failure_stage"]) for r in spark.read.schema(W.LEDGER).parquet(ledger).collect()}
    handle(rows, 0)
    assert state() == {
        ("shaky", "a", 0): ("failed", "assemble"), ("shaky", "b", 0): ("failed", "assemble"), ("partial", "a", 0): ("processed", None), ("partial", "b", 0): ("failed", "evidence"),
        ("whole", "a", 0): ("processed", None), ("whole", "b", 0): ("processed", None),
    }
    able["now"] = True
    handle(rows, 1)
    assert {k: v for k, v in state().items() if k[2] == 1} == {("shaky", "a", 1): ("processed", None), ("shaky", "b", 1): ("processed", None), ("partial", "b", 1): ("failed", "evidence")}


def test_late_free_drops_repeats(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, source, [("a", "2020-01-01 00:00:00"), ("a", "2020-01-01 05:00:00"), ("b", "2020-01-01 01:00:00")])
    stream = W.late_free(W.file_stream(spark, source, spark.createDataFrame([], RUNS).schema))
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["run_id"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


EVENTS = [("a", "2020-01-01 10:00:00", 1, "r1"), ("a", "2020-01-01 10:00:20", 2, "r2"), ("a", "2020-01-01 10:00:40", 3, "r1"), ("a", "2020-01-01 10:05:00", 4, "r1"), ("b", "2020-01-01 10:00:10", 5, "s1"), ("b", "2020-01-01 10:03:00", 6, "s1"),
          ("a", "2020-01-01 10:06:00", 7, "r3"), ("a", "2020-01-01 10:06:00", 8, "r4"), ("b", "2020-01-01 10:04:00", 9, "s2"), ("z", "2020-01-01 12:00:00", 10, "end")]


def test_order_holds_across_batches(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
        for rows in ([EVENTS[2], EVENTS[4]], [EVENTS[1], EVENTS[6], EVENTS[8]], [EVENTS[0], EVENTS[3], EVENTS[5], EVENTS[7]], [EVENTS[9]]):
            made = spark.createDataFrame(rows, "issue string, t string, seq long, revision string").select("issue", F.to_timestamp("t").alias("event_time"), "seq", "revision")
            made.coalesce(1).write.mode("append").parquet(source)
            changes = W.ordered_revision_changes(W.file_stream(spark, source, made.schema, 1), "1 hour")
            changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    want, last = [], {}
    for issue, at, seq, revision in sorted(EVENTS[:9], key=lambda e: (e[1], e[2])):
        if revision != last.get(issue):
            want.append((issue, seq, revision, last.get(issue)))
            last[issue] = revision
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("issue", "seq", "revision", "previous").collect()) == sorted(want)


class CountedState:
    """A list, value or map state, and a handle of them, in a dict; counts what is asked of it."""

    def __init__(self, calls, kept):
        self.calls, self.kept = calls, kept

    def __getattr__(self, name):
        if name.startswith("get") and name.endswith("State"):
            return lambda state, *_: CountedState(self.calls, self.kept.setdefault(state, {}))

        def call(*a):
            self.calls.append(name)
            k = self.kept
            if name in ("appendList", "put"):
                k["rows"] = [*(k.get("rows", []) if name == "appendList" else []), *a[0]]
            elif name == "update":
                k["value"] = a[0]
            elif name == "updateValue":
                k[a[0]] = a[1]
            elif name == "removeKey":
                del k[a[0]]
            elif name == "clear":
                k.clear()
            elif name == "registerTimer":
                k.setdefault("timers", set()).add(a[0])
            return {"exists": "value" in k, "get": k["value"] if "value" in k else k.get("rows", []), "iterator": list(k.items())}.get(name)

        return call


def test_many_publications_take_few_calls_of_the_store():
    calls, n = [], 400
    handle = CountedState(calls, {})
    audit = W.OrderedRevisionChanges(1000)
    audit.init(handle)
    rows = pd.DataFrame({"ms": [k * 700 for k in reversed(range(n))], "at": [f"{k:04}" for k in reversed(range(n))], "seq": [*reversed(range(n))], "revision": [f"r{k // 2}" for k in reversed(range(n))]})
    list(audit.handleInputRows(("a",), iter([rows]), TimerValues(0, 0)))
    until, got = 140_000, []
    while due := sorted(t for t in handle.kept["timers"] if t <= until):
        handle.kept["timers"].remove(due[0])
        got += [tuple(r) for part in audit.handleExpiredTimer(("a",), TimerValues(0, until), ExpiredTimerInfo(due[0])) for r in part.itertuples(index=False)]
    assert got == [("a", f"{k:04}", k, f"r{k // 2}", f"r{k // 2 - 1}" if k else None) for k in range(0, 200, 2)]
    assert len(calls) < 20
