import json

import pytest
from pyspark.sql import functions as F

from folioscope.functions import columns as C
from folioscope.functions import variants as X
from folioscope.operators import revisions as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rate_rounds_half_even_and_has_two_conventions(spark):
    assert one(spark, C.rate(F.lit(98), F.lit(110))) == 0.890909
    assert one(spark, C.rate(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, C.rate(F.lit(1), F.lit(0), None)) is None
    assert one(spark, C.percent(F.lit(1), F.lit(8))) == 12 and one(spark, C.percent(F.lit(3), F.lit(8))) == 38


@pytest.mark.parametrize("pages, name, page", [(["24"], "x", 24), (["12", "13"], "x", 12), ([], "page_5_panel_2", 5), (None, "12::NEW::1", None), (["true"], "x", None)])
def test_page_of(spark, pages, name, page):
    df = spark.createDataFrame([(pages, name)], "p array<string>, n string")
    assert df.select(C.page_of(F.col("p"), F.col("n")).alias("x")).first()["x"] == page


@pytest.mark.parametrize("name, carried, scope", [("12::NEW::1", None, "12"), ("x", 7, "7"), ("page_5_panel_2", None, "2"), ("cover", None, "cover")])
def test_page_scope(spark, name, carried, scope):
    df = spark.createDataFrame([(name, carried)], "n string, c int")
    assert df.select(C.page_scope(F.col("n"), F.col("c")).alias("x")).first()["x"] == scope


def test_iou_without_area(spark):
    zero = [F.lit(0.0)] * 8
    assert one(spark, C.iou(*zero)) == 0.0


@pytest.mark.parametrize(
    "generated, approved, category, distance",
    [
        ("x" * 100, "x" * 100, "accepted_unchanged", 0.0), ("x" * 100, "x" * 90 + "y" * 10, "minor_wording_edit", 0.1), ("x" * 100, "x" * 89 + "y" * 11, "moderate_rewrite", 0.11), ("x" * 100, "x" * 65 + "y" * 35, "moderate_rewrite", 0.35),
        ("x" * 100, "x" * 50 + "y" * 50, "major_rewrite", 0.5), ("x" * 100, "x" * 30 + "y" * 70, "major_rewrite", 0.7), ("x" * 100, "y" * 100, "complete_replacement", 1.0), (None, None, "abstention", None), ("", "a", "added", 1.0), ("a", None, "removed", 1.0),
    ],
)
def test_revision_classes(spark, generated, approved, category, distance):
    row = R.classify(spark.createDataFrame([(generated, approved)], "generated string, approved string")).first()
    assert (row["category"], row["distance"]) == (category, distance)


def test_equal_text_of_other_structure_is_an_edit(spark):
    rows = [('{"a":"x\\nb=y"}', '{"a":"x","b":"y"}'), ('["a","b"]', '["a","b"]'), ('{"a":1,"b":2}', '{"b":2,"a":1}'), ("[]", "null"), ('[""]', "[]"), ('""', '"a"'), (None, None)]
    df = spark.createDataFrame(rows, "g string, a string").select(F.try_parse_json("g").alias("generated_value"), F.try_parse_json("a").alias("approved_value"))
    got = [(r["category"], r["distance"]) for r in R.classify_values(df).collect()]
    assert got == [("minor_wording_edit", 0.0), ("accepted_unchanged", 0.0), ("accepted_unchanged", 0.0), ("abstention", None), ("removed", 1.0), ("added", 1.0), ("abstention", None)]


def test_other_schema_versions_are_not_compared(spark):
    row = R.classify(spark.createDataFrame([("a", "b", "schema_mismatch")], "generated string, approved string, status string")).first()
    assert (row["category"], row["distance"], row["weight"]) == ("unsupported_schema", None, None)


@pytest.mark.parametrize("a, b", [("kitten", "sitting"), ("", "abc"), ("same", "same"), ("prefix middle suffix", "prefix mitte suffix"), ("aaa", "aaaa"), ("abab", "baba"), ("é😀x", "é😀y"), ("x" * 5000 + "a" + "y" * 5000, "x" * 5000 + "bc" + "y" * 5000)])
def test_edit_distance_of_the_changed_part(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got, plain = df.select(C.edit_distance(F.col("a"), F.col("b")), F.levenshtein("a", "b")).first()
    assert got == plain / max(len(a), len(b))


@pytest.mark.parametrize("origin, has, disposition, fresh", [(None, False, None, True), (None, False, "preserved", False), ("generated", True, "preserved", True), ("carried_forward", True, "fresh", False), (None, True, "fresh", False)])
def test_freshness(spark, origin, has, disposition, fresh):
    df = spark.createDataFrame([(origin, has, disposition)], "o string, h boolean, d string")
    assert df.select(R.counts_toward_acceptance(F.col("o"), F.col("h"), F.col("d")).alias("x")).first()["x"] is fresh


def plain_canon(v):
    if v is None:
        return ""
    if isinstance(v, str):
        return v
    if isinstance(v, list):
        return "\n".join(map(plain_canon, v))
    if isinstance(v, dict):
        return "\n".join(f"{k}={plain_canon(v[k])}" for k in sorted(v))
    return json.dumps(v)


NESTED = ['["a","b"]', '{"b":"2","a":"1"}', '"s"', "null", '{"b":1,"a":null,"c":[1,{"z":"2","y":["q","r"]},[]],"d":{}}', '["a",["b",["c",[[["d"]]]]]]', '"q\\"[{"', '[[],{},""]', "true", "12", '{"k":"\\\\","j":["{"]}', '{"é":{"Z":{"a":[false]}}}']


def test_canonical_text(spark):
    df = spark.createDataFrame([(j,) for j in NESTED], "j string").select("j", F.parse_json("j").alias("v"))
    rows = df.select("j", X.canonical(F.col("v")).alias("x"), C.is_empty_value(F.col("v")).alias("empty"), X.kind(F.col("v")).alias("kind")).collect()
    names = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", type(None): "null"}
    for r in rows:
        v = json.loads(r["j"])
        assert r["x"] == plain_canon(v) and r["empty"] == (v in (None, "", [], {})) and r["kind"] == names[type(v)]


def test_axes_key_ignores_the_order_of_axes(spark):
    a = one(spark, C.axes_key("cmp", {"x": F.lit("1"), "y": F.lit(None)}))
    assert a == one(spark, C.axes_key("cmp", {"y": F.lit(None), "x": F.lit("1")})) and len(a) == 16
