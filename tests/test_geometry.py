import random

import pytest

from folioscope import storage
from folioscope.operators import geometry as G
from folioscope.plans import views as V
from folioscope.storage import shared_table

G_SCHEMA = "review_id int, stratum string, page_scope string, box_id string, ord int, x double, y double, w double, h double"


def sides(spark, generated, approved):
    g = spark.createDataFrame([(1, s, p, i, o, *b) for s, p, i, o, b in generated], G_SCHEMA)
    a = spark.createDataFrame([(1, s, p, i, o, *b, d) for s, p, i, o, b, d in approved], G_SCHEMA + ", deleted boolean")
    return g, a, G.matches(g, a)


FULL, LEFT, RIGHT = (0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 0.5, 1.0), (0.5, 0.0, 0.5, 1.0)


def totals(delta):
    return {r["stratum"]: r for r in delta.collect()}


def test_split_and_merge(spark):
    g, a, m = sides(spark, [("page", "1", "g1", 1, LEFT), ("page", "1", "g2", 2, RIGHT)], [("page", "1", "a1", 1, FULL, False)])
    total = totals(G.geometry_delta(g, a, m))["total"]
    assert (total["split_rate"], total["recall"], total["precision"], total["unchanged_geometry_rate"]) == (1.0, 1.0, 1.0, 0.0)
    g, a, m = sides(spark, [("page", "1", "g1", 1, FULL)], [("page", "1", "a1", 1, LEFT, False), ("page", "1", "a2", 2, RIGHT, False)])
    assert totals(G.geometry_delta(g, a, m))["total"]["merge_rate"] == 1.0


def test_false_missing_and_deleted(spark):
    g, a, m = sides(spark, [("page", "1", "g1", 1, LEFT)], [("page", "1", "a1", 1, RIGHT, False), ("page", "1", "a2", 1, LEFT, True)])
    total = totals(G.geometry_delta(g, a, m))["total"]
    assert (total["false_rate"], total["missing_rate"], total["approved"], total["corrections"]) == (1.0, 1.0, 1, 2)
    operations = {r["operation"] for r in G.correction_ledger(g, a, m).collect()}
    assert operations == {"false_panel", "missing_panel"}


def test_same_box_on_two_pages_never_matches(spark):
    assert sides(spark, [("page", "1", "g1", 1, FULL)], [("page", "2", "a1", 1, FULL, False)])[2].count() == 0


def test_missing_pages_match_each_other(spark):
    assert sides(spark, [("page", None, "g1", 1, FULL)], [("page", None, "a1", 1, FULL, False)])[2].count() == 1


def test_strata_stay_apart_and_add_up(spark):
    g, a, m = sides(
        spark,
        [("page", "1", "g1", 1, FULL), ("page", "2", "g2", 1, FULL), ("page", "3", "g3", 1, FULL)],
        [("page", "1", "a1", 1, FULL, False), ("page", "2", "a2", 1, FULL, False), ("page", "3", "a3", 1, FULL, False), ("page", "4", "a4", 1, FULL, False), ("spread", "5", "a5", 1, FULL, False)],
    )
    found = totals(G.geometry_delta(g, a, m))
    assert (found["total"]["precision"], found["total"]["recall"]) == (1.0, 0.6)
    assert (found["page"]["recall"], found["spread"]["recall"]) == (0.75, 0.0)


def test_reversed_order_has_no_agreement(spark):
    halves = [LEFT, RIGHT]
    _, _, m = sides(spark, [("page", "1", f"g{k}", k, b) for k, b in enumerate(halves)], [("page", "1", f"a{k}", 9 - k, b, False) for k, b in enumerate(halves)])
    row = G.reading_order(G.best_matches(m)).first()
    assert (row["concordant"], row["discordant"], row["agreement"]) == (0, 1, 0.0)


def test_over_segmentation_lowers_accuracy(spark):
    g, a, m = sides(spark, [("page", "1", "g1", 1, FULL), ("page", "1", "g2", 2, LEFT)], [("page", "1", "a1", 1, FULL, False)])
    row = {r["stratum"]: r for r in G.segmentation_accuracy(G.geometry_delta(g, a, m)).collect()}["total"]
    assert row["accuracy"] == 0.5 and row["target"] == "below"


@pytest.mark.parametrize("area, band", [((0.1, 0.2), "small"), ((0.3, 0.1), "medium"), ((0.4, 0.3), "large")])
def test_size_bands(spark, area, band):
    g, a, m = sides(spark, [], [("page", "1", "a1", 1, (0.0, 0.0, *area), False)])
    row = G.panel_size_recall(g, a, m).first()
    assert (row["size_band"], row["recall"]) == (band, 0.0)


@pytest.mark.parametrize("least", [0.5, 0.2])
def test_crowded_pages_find_the_same_pairs(spark, least):
    rng = random.Random(3)
    boxes = []
    for k in range(400):
        w, h = 2.0 ** rng.uniform(-6, 0), 2.0 ** rng.uniform(-6, 0)
        boxes.append(("r", "page", rng.choice(["1", "1", "1", None]), k, rng.uniform(-0.2, 1), rng.uniform(-0.2, 1), rng.choice([w, w, 0.25, 0.0]), rng.choice([h, h, 0.5]), k, False))
        x, y = boxes[-1][4:6]
        boxes.append(("r", "page", boxes[-1][2], 1000 + k, x + rng.uniform(-0.1, 0.1) * boxes[-1][6], y, boxes[-1][6] * rng.choice([1, 0.5, 2]), boxes[-1][7], k, k % 17 == 0))
    df = spark.createDataFrame(boxes, "review_id string, stratum string, page_scope string, box_id int, x double, y double, w double, h double, ord int, deleted boolean")
    found = lambda crowded: {(r["gen_id"], r["app_id"]) for r in G.matches(df, df, least, crowded).collect()}
    rows = [(r["gen_id"], r["app_id"]) for r in G.matches(df, df, least, 0).collect()]
    assert len(rows) == len(set(rows)) > 500 and set(rows) == found(1 << 30)
    pairs = lambda crowded: {(r["first_id"], r["second_id"]) for r in G.page_overlaps(df, least, crowded).collect()}
    assert pairs(0) == pairs(1 << 30)
    compared = G._celled(G.paged(df), G._crowds(G.paged(df)), 0, None).join(G._celled(G.paged(df), G._crowds(G.paged(df)), 0, least).select(*G.PAGE, "_cell"), [*G.PAGE, "_cell"]).count()
    assert compared < 0.2 * 800 * 800


def test_reading_order_counts_every_pair(spark):
    rng = random.Random(5)
    rows = [("r", "page", page, page, k, rng.choice([None, *range(size)]), rng.choice([None, *range(size)])) for page, size in (("1", 60), ("2", 3), ("3", 1), ("4", 200)) for k in range(size)]
    best = spark.createDataFrame(rows, "review_id string, stratum string, page_key string, page_scope string, app_id int, gen_ord int, app_ord int")
    want = {}
    for page in "1234":
        of = [(g, a) for _, _, p, _, _, g, a in rows if p == page and g is not None and a is not None]
        turns = [(g1 - g2) * (a1 - a2) for i, (g1, a1) in enumerate(of) for g2, a2 in of[:i]]
        want[page] = (sum(t > 0 for t in turns), sum(t < 0 for t in turns))
    assert {r["page_scope"]: (r["concordant"], r["discordant"]) for r in G.reading_order(best).collect()} == want


def test_lines_are_summed_once_and_no_box_is_sorted_for_its_count(spark, sf):
    generated, approved = V.boxes(spark, sf)
    plan = G.matches(generated, approved)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") <= 1


def test_more_boxes_take_more_tasks(spark, sf, monkeypatch):
    generated, approved = V.boxes(spark, sf)
    few = G.matches(generated, approved)
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    many = shared_table(G.matches(generated, approved), "pairs")
    best, tasks = G.best_matches(many), -(-many.count() // 500)
    assert tasks > 4 and best.rdd.getNumPartitions() == tasks and G.marked(many).rdd.getNumPartitions() == tasks
    assert sorted(map(tuple, many.collect()), key=repr) == sorted(map(tuple, few.collect()), key=repr)


def test_reports_of_more_lines_take_more_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    tasks = -(-V.table(spark, sf, "lineitem").count() // 500)
    plan = V.reports(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert tasks > 4 and all(f", {tasks}), REPARTITION_BY_NUM" in line for line in plan.splitlines() if "Exchange hashpartitioning(l_orderkey" in line or "Exchange hashpartitioning(o_orderkey" in line)
    assert plan.count(f", {tasks}), REPARTITION_BY_NUM") == 2
