from pyspark.sql import functions as F

from folioscope.operators import benchmarks as B
from folioscope.operators import history as H
from folioscope.operators import materials as M
from folioscope.operators import registry as G
from folioscope.operators import projections as J
from folioscope.operators import reports as S

PLACE = "publisher string, title_group string, series string, issue int, run_seq int, comparability_key string, metric string, num long, den long"


def test_benchmarks_add_counts_not_rates(spark):
    pts = spark.createDataFrame([("p", "t", "s", 1, 1, "k", "m", 8, 10), ("p", "t", "s", 2, 2, "k", "m", 90, 100), ("p", "t", "z", 1, 3, "other", "m", 1, 2)], PLACE)
    rows = {(r["level"], r["series"], r["comparability_key"]): r for r in B.hierarchy(pts).where("level <> 'issue'").collect()}
    assert rows["series", "s", "k"]["value"] == 0.890909 and rows["platform", None, "k"]["issues"] == 2
    assert rows["platform", None, "other"]["value"] == 0.5


def test_same_leaf_in_two_series_is_two_issues(spark):
    pts = spark.createDataFrame([("p", "t", "a", 1, 1, "k", "m", 1, 1), ("p", "t", "b", 1, 1, "k", "m", 1, 1)], PLACE)
    row = B.hierarchy(pts).where("level = 'publisher'").first()
    assert (row["issues"], row["series_count"]) == (2, 2)


def test_scope_filter_has_no_false_prefix(spark):
    df = spark.createDataFrame([("a/killers",), ("a/killers/1",), ("a/killers2/1",)], "path string")
    assert {r["path"] for r in B.scope_filter(df, "series", "a/killers").collect()} == {"a/killers", "a/killers/1"}


def test_history_trend_polarity_and_band(spark):
    df = spark.createDataFrame([("d", "1", 50, 10), ("d", "2", 60, 11), ("e", "1", 5, 5)], "dataset string, day string, quality_score int, weak_percent int")
    rows = {(r["dataset"], r["metric"]): r for r in H.trends(df, {"quality_score": False, "weak_percent": True}).collect()}
    assert (rows["d", "quality_score"]["direction"], rows["d", "weak_percent"]["direction"]) == ("improving", "stable")
    assert rows["d", "quality_score"]["confidence"] == "preliminary" and rows["e", "quality_score"]["confidence"] == "insufficient_history"
    assert H.since_previous(df, ["quality_score"]).first()["quality_score_delta"] == 10


def test_capped_history_keeps_the_newest(spark):
    df = spark.range(40).select(F.lit("d").alias("dataset"), F.lpad(F.col("id").cast("string"), 3, "0").alias("day"))
    rows = H.capped(df).orderBy("place").collect()
    assert len(rows) == 30 and rows[0]["day"] == "010"


def materials(spark, rows, edges):
    m = spark.createDataFrame([("t", *r) for r in rows], "target_id string, material_id string, level string, status string, edition_id string, revision int")
    e = spark.createDataFrame([("t", *r) for r in edges], "target_id string, material_id string, level string, supersedes_id string, binding_status string")
    return m, e


OK = ("publisher_approved", None, 1)


def kept(m, e):
    return {r["material_id"] for r in M.effective(m, e).collect()}


def test_cascade(spark):
    assert kept(*materials(spark, [("a", "issue", *OK), ("b", "series", *OK)], [("a", "issue", "b", "bound")])) == {"a"}
    assert kept(*materials(spark, [("a", "issue", *OK), ("b", "series", *OK)], [("b", "series", "a", "bound")])) == {"a", "b"}  # broader never suppresses narrower
    assert kept(*materials(spark, [("a", "issue", *OK), ("b", "issue", *OK)], [("a", "issue", "b", "bound")])) == {"a", "b"}  # same scope
    assert kept(*materials(spark, [("a", "issue", *OK), ("b", "series", *OK)], [("a", "issue", "b", "unbound")])) == {"a", "b"}
    chain = [("a", "issue", *OK), ("b", "series", *OK), ("c", "publisher", *OK)]
    assert kept(*materials(spark, chain, [("a", "issue", "b", "bound"), ("b", "series", "c", "bound")])) == {"a", "c"}  # a suppressed record suppresses nothing
    assert kept(*materials(spark, [("a", "issue", "draft", None, 1), ("b", "series", "retired", None, 1), ("c", "series", "publisher_approved", "special", 1)], [])) == set()


def test_lineage_conflicts(spark):
    m, e = materials(spark, [(x, "series", *OK) for x in "abcd"], [("a", "series", "b", "bound"), ("b", "series", "c", "bound"), ("d", "series", "x", "bound")])
    rows = M.lineage_conflicts(m, e).collect()
    assert [(r["lineage"], r["approved"]) for r in rows] == [("a", 3)]


def test_health_roll_up_of_roll_ups(spark):
    df = spark.createDataFrame(
        [("p", "t", "s", 1, 1, "platform_approved", "audited"), ("p", "t", "s", 2, None, "draft", "audited"), ("p", "t", "z", 3, 4, "draft", "failed")],
        "publisher string, title_group string, series string, issue int, revision int, state string, audit_state string",
    )
    issues = G.issue_health(df)
    assert {r["issue"]: (r["health"], r["reasons"]) for r in issues.collect()} == {1: ("healthy", ""), 2: ("unknown", "no_published_revision"), 3: ("attention", "not_platform_approved,audit_failed")}
    row = G.publisher_health(G.series_health(issues)).first()
    assert (row["issues"], row["attention"], row["health"]) == (3, 1, "attention")


def test_publishing_twice_adds_nothing(spark):
    fresh = spark.createDataFrame([("i", "2020", "run_a"), ("i", "2021", "run_b"), ("j", "2020", "run_c")], "issue string, at string, run_id string")
    none = fresh.limit(0).withColumn("run_seq", F.lit(0).cast("long"))
    first = S.publish(fresh, none, ["issue"])
    assert {(r["run_id"], r["run_seq"]) for r in first.collect()} == {("run_a", 1), ("run_b", 2), ("run_c", 1)}
    assert S.publish(fresh, first, ["issue"]).count() == 0
    more = S.publish(fresh.unionByName(spark.createDataFrame([("i", "2019", "run_d")], fresh.schema)), first, ["issue"]).collect()
    assert [(r["run_id"], r["run_seq"], r["report_id"]) for r in more] == [("run_d", 3, "run000003")]


def test_verify_written(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert S.verify_written(a, a, "k").count() == 0
    assert [tuple(r) for r in S.verify_written(a, a.where("k = 1"), "k").collect()] == [(2, "missing")]


def test_ledger_success_clears_failure(spark):
    df = spark.createDataFrame([("r", "f", 1, "1", "failed", "publish"), ("r", "f", 2, "2", "processed", None)], "revision string, fingerprint string, attempt int, at string, status string, failure_stage string")
    row = S.ledger_state(df).first()
    assert (row["attempts"], row["first_seen"], row["status"], row["failure_stage"]) == (2, "1", "processed", None)
    current = spark.createDataFrame([("r",), ("q",)], "revision string")
    assert [r["revision"] for r in S.unprocessed(current, df, "f").collect()] == ["q"]
    assert S.unprocessed(current, df, "g").count() == 2 and S.unprocessed(current, df, "f", force=True).count() == 2


def test_null_metric_never_matches_a_range(spark):
    df = spark.createDataFrame([(1, None), (2, 0.5)], "id int, precision double")
    assert [r["id"] for r in S.search_index(df, within={"precision": (None, 1.0)}).collect()] == [2]


def test_a_later_load_wins(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, load int, v string")
    new = spark.createDataFrame([("a", 3, "late"), ("a", 2, "early"), ("b", 1, "same load")], "id string, load int, v string")
    assert {(r["id"], r["v"]) for r in S.upsert(old, new, ["id"], "load").collect()} == {("a", "late"), ("b", "same load")}


def test_archive_search_meets_all_filters(spark):
    rows = [(1, "s", "2024-01-02", 0.7, ["geometry.false_panels"], {"WARNING": 1}, "abc", "rev_1"), (2, "s", "2024-01-03", None, ["x"], {"WARNING": 0}, None, "rev_2"), (3, "s", "2024-01-03", 0.9, None, None, "zabz", "rev_3")]
    df = spark.createDataFrame(rows, "run_seq int, scope string, at string, precision double, finding_codes array<string>, finding_counts map<string,int>, publisher_commit string, published_revision_id string")
    both = S.archive(df, df.limit(0).drop("precision"))
    ids = lambda **q: [r["run_seq"] for r in S.search_archive(both, **q).orderBy("place").collect()]
    assert ids() == [3, 2, 1]
    assert ids(ranges=[("precision", "<", 0.8)]) == [1] and ids(ranges=[("precision", ">=", 0.7)]) == [3, 1] and ids(ranges=[("recall", ">", 0)]) == []
    assert ids(findings=["geometry.false_panels"]) == [1] and ids(severities=["WARNING"]) == [1] and ids(fields={"commit": "ab"}) == [3, 1]
    assert ids(fields={"revision": "rev_2", "date_from": "2024-01-03"}) == [2] and ids(kinds=["failed_run"]) == [] and ids(texts=["nothing"]) == []


def test_cross_check_compares_files_and_versions(spark):
    f = lambda *p: [tuple(x) for x in p]
    schema = "target_id string, material_id string, files array<struct<file_id:string,revision:string>>"
    ours = spark.createDataFrame([("t", "a", f(("1", "x"), ("2", "y"))), ("t", "b", f(("1", "x"))), ("t", "c", f((None, None))), ("u", "a", [])], schema)
    theirs = spark.createDataFrame([("t", "a", f(("2", "y"), ("1", "x"))), ("t", "b", f(("1", "z"))), ("t", "d", []), ("t", "c", f((None, None))), ("t", "c", []), ("v", "a", [])], schema)
    versions = spark.createDataFrame([("t", "1", None), ("u", "1", "0"), ("v", "7", "7")], "target_id string, contract_version string, published_version string")
    got = {(r["target_id"], r["material_id"]): r["status"] for r in M.cross_check(ours, theirs, versions).collect()}
    assert got == {("t", "a"): "agree", ("t", "b"): "file_mismatch", ("t", "c"): "duplicate", ("t", "d"): "published_only", ("u", None): "version_skew", ("v", None): "unsupported_resolution_contract_version"}


def test_unknown_series_need_attention_too(spark):
    df = spark.createDataFrame([("p", "t", "s", "healthy"), ("p", "t", "y", "unknown"), ("p", "t", "z", "attention")], "publisher string, title_group string, series string, health string")
    df = df.selectExpr("*", "1L issues", "1L healthy", "0L attention", "0L unknown")
    assert {r["series"] for r in G.cross_series_health(df).collect()} == {"y", "z"}


def test_stagnant_domains_and_changes(spark):
    scores = spark.createDataFrame([("d", "1", 100), ("d", "2", 100), ("d", "3", 100)], "dataset string, day string, artifacts int")
    failures = spark.createDataFrame([("d", "1", "a", 50), ("d", "1", "b", 10), ("d", "2", "c", 5), ("d", "3", "a", 51), ("d", "3", "c", 1)], "dataset string, day string, failure string, failures int")
    assert [(r["domain"], r["first"], r["last"]) for r in H.stagnant_domains(failures, scores, {"a": "x", "b": "y", "q": "z"}).collect()] == [("x", 50, 51)]
    assert {(r["failure"], r["status"]) for r in H.new_and_resolved(failures).collect()} == {("c", "new"), ("b", "resolved")}
    assert {(r["failure"], r["status"]) for r in H.new_and_resolved(failures, newest=True).collect()} == {("a", "new")}


def test_reports_are_summed_by_issue_before_metrics_become_rows(spark):
    rows = [("p", "t", "s", k % 3, f"k{k % 2}", k, None if k == 4 else 10, k * 2, 7) for k in range(12)]
    reports = spark.createDataFrame(rows, "publisher string, title_group string, series string, issue int, comparability_key string, a long, den long, b long, of long")
    metrics = {"a": ("a", "den"), "b": ("b", "of")}
    plain = lambda df: sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    made = B.hierarchy_of_reports(reports, metrics)
    assert plain(made) == plain(B.hierarchy(B.points(reports, metrics)))
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()  # rows per metric come after what is stored


def test_a_projection_is_made_once(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 3).alias("level"), "id", F.uuid().alias("made"))  # another one each time that it is made
    assert J.rebuild(spark, str(tmp_path), {"p": (rows, "level", ("id",))}, "now").collect() == [("p", "rebuilt")]
