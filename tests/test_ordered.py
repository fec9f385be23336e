"""Ranks, previous values, running sums and medians by range, and tables kept by key, against plain versions."""

import os
import statistics

import pytest
from pyspark.sql import functions as F

from folioscope.operators import ordered as O
from folioscope.operators import quality as Q
from folioscope.operators import reports as S
from folioscope.operators import tables as T

ROWS = [("hot", k * 7 % 401, k % 3) for k in range(2000)] + [("a", 5, 1), ("b", None, 2), ("b", 3, 0), (None, 1, 1), (None, 2, 0)]


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small ranges would be put together again."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(g, v, w, i) for i, (g, v, w) in enumerate(ROWS)]
    return spark.createDataFrame(data, "g string, v int, w int, id int").repartition(5)


def plain(order):
    groups = {}
    for i, (g, v, w) in enumerate(ROWS):
        groups.setdefault(g, []).append((v, w, i))
    return {g: sorted(rs, key=order) for g, rs in groups.items()}


def test_one_group_lies_in_many_ranges(rows):
    spread = O.placed(rows, ["g"], [F.col("v"), F.col("id")]).where("g = 'hot'").groupBy("_range").count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 2000


@pytest.mark.parametrize("down", [False, True])
def test_numbers(rows, down):
    order = [O.Down(F.col("v")) if down else F.col("v"), F.col("id")]
    got = {r["id"]: r["n"] for r in O.ranked(rows, ["g"], order, "n").collect()}
    none = float("inf") if down else -1
    want = plain(lambda x: (none if x[0] is None else -x[0] if down else x[0], x[2]))
    assert got == {i: n for rs in want.values() for n, (_, _, i) in enumerate(rs, 1)}


def test_previous_and_running(rows):
    placed = O.with_running_sum(O.with_previous(O.placed(rows, ["g"], [F.col("v"), F.col("id")]), ["g"], {"pv": "v", "pid": "id"}), ["g"], F.col("w"), "upto")
    got = {r["id"]: (r["pv"], r["pid"], r["_has_previous"], r["upto"]) for r in placed.collect()}
    want = {}
    for rs in plain(lambda x: (-1 if x[0] is None else x[0], x[2])).values():
        total, before = 0, None
        for v, w, i in rs:
            total += w
            want[i] = (before[0] if before else None, before[2] if before else None, before is not None, total)
            before = (v, w, i)
    assert got == want


def test_exact_medians(rows):
    got = {r["g"]: r["median"] for r in O.exact_medians(rows, ["g"], "v").collect()}
    assert got == {g: statistics.median([v for v, _, _ in rs if v is not None]) for g, rs in plain(lambda x: x[2]).items()}


def test_plans_hold_no_window_over_a_group(spark, rows):
    assessed = rows.select(F.col("g").alias("dataset"), F.col("id").alias("artifact_id"), F.lit("high").alias("severity"), F.col("w").alias("severity_rank"), F.col("v").alias("page"), F.lit(1).alias("effort"), F.col("v").alias("score"))
    for ranked in (Q.priority_rank(assessed), Q.weak_queue(assessed)):
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert all("sum(_n" in w for w in windows)


def test_empty(rows):
    none = rows.limit(0)
    assert O.ranked(none, ["g"], [F.col("v")], "n").count() == 0 and O.exact_medians(none, ["g"], "v").count() == 0


def test_run_ids_beyond_six_digits(spark):
    df = spark.createDataFrame([(7,), (999999,), (1234567,)], "n long")
    assert [r["x"] for r in df.select(S.numbered_id(F.col("n")).alias("x")).collect()] == ["run000007", "run999999", "run1234567"]


def test_written_rows_of_repeated_and_null_keys(spark):
    made = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), (None, 1), ("c", 1)], "k string, v int")
    assert S.verify_written(made, made, "k").isEmpty()
    kept = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), (None, 2), ("d", 1)], "k string, v int")
    assert {(r["k"], r["why"]) for r in S.verify_written(made, kept, "k").collect()} == {("b", "differs"), (None, "differs"), ("c", "missing"), ("d", "unexpected")}


def files(path):
    return {b: sorted(f for f in os.listdir(f"{path}/{b}") if f.endswith(".parquet")) for b in os.listdir(path) if b.startswith("_bucket=")}


def test_a_load_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "table")
    table = T.KeyedTable(spark, path, ["k"], "k long, v string, n int", buckets=16)
    merge = T.keep_latest(["k"], "n")
    assert table.read().count() == 0
    table.load(spark.range(1000).selectExpr("id k", "'old' v", "0 n"), 0, merge)
    before = files(path)
    keys = [3, 500]
    fresh = spark.createDataFrame([(k, "new", 1) for k in keys] + [(None, "null key", 1), (1001, "added", 1)], "k long, v string, n int")
    touched = table.load(fresh, 1, merge)
    after = files(path)
    assert {b for b in after if after[b] != before.get(b)} == {f"_bucket={b}" for b in touched} and len(touched) <= 4
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(got) == 1002 and got[3] == got[500] == "new" and got[None] == "null key" and got[4] == "old"
    assert table.load(fresh, 1, merge) == [] and files(path) == after
    assert table.load(fresh.limit(0), 2, merge) == []


def test_a_ledger_folds_however_it_is_split(spark, tmp_path):
    data = [(r, f, f"2024-01-0{1 + (r + a) % 5}", a, "failed" if a % 3 else "processed", "publish" if a % 3 else None) for a, (r, f) in enumerate([(1, "x"), (1, "x"), (2, "x"), (1, "y"), (1, "x"), (2, "x"), (3, None), (3, None)])]
    log = spark.createDataFrame(data, "revision long, fingerprint string, at string, attempt long, status string, failure_stage string")
    want = sorted(map(repr, map(tuple, S.ledger_state(log).collect())))
    for split in (1, 2, 5):
        table = T.ledger_table(spark, str(tmp_path / f"ledger{split}"), buckets=4)
        for n in reversed(range(split)):
            part = log.where(F.col("attempt") % split == n)
            for _ in range(2):  # a load that is run again counts once
                table.load(T.ledger_of(part), split - n, T.fold_ledger)
        assert sorted(map(repr, map(tuple, T.ledger_rows(table.read()).collect()))) == want
