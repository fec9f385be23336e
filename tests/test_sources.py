import base64
import hashlib
import json

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from folioscope.functions import variants as X
from folioscope.operators import revisions as E
from folioscope.plans import ingest_plans, report_plans, review_plans
from folioscope import storage
from folioscope.sources import adapters as A
from folioscope.sources import contracts as K
from folioscope.sources import ingest as I
from folioscope.storage import shared_table

PREFIX = "publishers/p/title_groups/t/series/s/issues/i{}"


def snapshot(names, spoil=None):
    rows = []
    for n in names:
        body = n.encode()
        rows.append({"path": n, "content_b64": "%%" if spoil == "base64" else base64.b64encode(body).decode(), "sha256": "0" if spoil == "file" else hashlib.sha256(body).hexdigest(), "size": len(body)})
    return json.dumps({"artifacts": rows}).encode()


def test_discovery_reads_paths_only(spark, tmp_path):
    for k in range(2):
        folder = tmp_path / PREFIX.format(k) / "approved"
        folder.mkdir(parents=True)
        (folder / "published.json").write_text(json.dumps({"revision_id": f"rev_{k}", "revision_key": "k"}))
    (tmp_path / "publishers/broken/approved").mkdir(parents=True)
    (tmp_path / "publishers/broken/approved/published.json").write_text("{}")
    paths = I.files(spark, str(tmp_path)).select("path")
    assert sorted(r["issue_id"] for r in I.discover_issues(paths).collect()) == ["i0", "i1"]


def test_documents_are_written_and_listed_without_their_content(spark, tmp_path):
    rows = [(f"{PREFIX.format(k)}/approved/published.json", b"x" * k if k else None) for k in range(5)] + [(None, b"lost")]
    made = I.write_files(spark.createDataFrame(rows, "path string, content binary"), f"file://{tmp_path}/store")
    assert sorted(r["length"] for r in made.collect()) == [0, 1, 2, 3, 4]
    listed = I.discover_issues(I.files(spark, f"{tmp_path}/store").select("path"))
    assert sorted(r["issue_id"] for r in listed.collect()) == [f"i{k}" for k in range(1, 5)]  # an empty file is not listed
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1].splitlines()[0]


def test_snapshots_and_quarantine(spark):
    good, short, bad64, badfile = snapshot(I.REQUIRED_FILES), snapshot(I.REQUIRED_FILES[:2]), snapshot(I.REQUIRED_FILES, "base64"), snapshot(I.REQUIRED_FILES, "file")
    rev = lambda b: "rev_" + hashlib.sha256(b).hexdigest()
    pointers = [("good", rev(good), "k1"), ("wrong", "rev_0", "k1"), ("short", rev(short), "k2"), ("bad64", rev(bad64), "k3"), ("badfile", rev(badfile), "k4"), ("gone", "rev_1", "k9"), ("nokey", "rev_2", "")]
    content = [(p, json.dumps({"revision_id": r, "revision_key": k}).encode()) for p, r, k in pointers]
    able, refused = I.resolve_pointers(spark.createDataFrame(content, "issue_prefix string, content binary"))
    assert [(r["issue_prefix"], r["reject_reason"]) for r in refused.collect()] == [("nokey", "no_revision_key")]
    stored = spark.createDataFrame([("k1", good), ("k2", short), ("k3", bad64), ("k4", badfile)], "key string, content binary")
    whole, rejected = I.extract_snapshots(able, stored)
    assert {r["issue_prefix"] for r in whole.collect()} == {"good"} and whole.count() == 3
    reasons = {(r["issue_prefix"], r["reject_reason"]) for r in rejected.collect()}
    assert {("wrong", "snapshot_hash"), ("gone", "missing_snapshot"), ("short", "missing_file"), ("bad64", "bad_base64"), ("badfile", "file_hash")} <= reasons


def test_contract_list_bare_and_wrapped(spark):
    df = spark.createDataFrame([(1, '[{"a":1},{"a":2}]'), (2, '{"rows":[{"a":3}]}'), (3, "no json")], "k int, content string")
    got = I.contract_list(df, "rows").select("k", F.variant_get("record", "$.a", "int").alias("a")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1), (1, 2), (2, 3)]


def test_manifest(spark):
    issues = spark.createDataFrame([("i",)], "issue_prefix string")
    objects = spark.createDataFrame([("i", "approved_pointer", b"x", None), ("i", "processing_snapshot", b"yy", None), ("i", "review_report", None, "denied")], "issue_prefix string, role string, content binary, error string")
    rows = {r["role"]: r for r in I.evidence_manifest(issues, objects).collect()}
    assert (rows["review_report"]["status"], rows["platform_approval"]["status"], rows["processing_snapshot"]["size"], rows["review_report"]["loaded"], rows["review_report"]["audit_ready"]) == ("denied", "missing", 2, 2, True)


def plain_violations(doc, schema, path="$"):
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}
    kind, wanted = kinds[type(doc)], schema.get("type")
    names = [wanted] if isinstance(wanted, str) else wanted
    if names and kind not in names and not (kind == "integer" and "number" in names):
        return [(path, f"type:{kind}")]
    out = [(path, "enum:" + json.dumps(doc, separators=(",", ":")))] if "enum" in schema and not any(doc == e and type(doc) is type(e) for e in schema["enum"]) else []
    out += [(path, k) for k in ("oneOf", "anyOf") if k in schema and all(plain_violations(doc, s) for s in schema[k])]
    if kind == "object":
        out += [(path, f"missing:{n}") for n in schema.get("required", ()) if n not in doc]
        for n, s in schema.get("properties", {}).items():
            out += plain_violations(doc[n], s, f"{path}.{n}") if n in doc else []
    if kind == "array" and "items" in schema:
        for i, x in enumerate(doc):
            out += plain_violations(x, schema["items"], f"{path}[{i}]")
    return out


LEAF = {"oneOf": [{"type": "integer"}, {"type": "array", "items": {"type": ["string", "null"]}}]}
CONTRACT = {
    "type": "object", "required": ["n", "a"],
    "properties": {"n": {"type": ["string", "null"]}, "a": {"type": "array", "items": {"type": "object", "required": ["b"], "properties": {"b": LEAF, "e": {"enum": ["x", 1, None]}, "f": {"type": "number"}, "d": {"items": {"items": LEAF}}}}}},
}
DOCS = [
    '{"n":null,"a":[{"b":1},{"b":["q",null]},{"b":"no"},{"e":"y","b":[2]},5,{"b":3,"e":null,"f":2},{"b":4,"e":1,"f":2.5}]}', '{"n":1}', "[1]", '{"n":"x","a":[{"b":true,"f":true}]}', '{"n":"x","a":[]}', "null", '"s"',
    '{"n":"x","a":[{"b":1,"d":[[1,["z"],"bad"],"skipped",[[4]]]}],"more":{"deep":[1]}}',
]


def test_conformance_of_nested_documents(spark):
    df = spark.createDataFrame([(k, j) for k, j in enumerate([*DOCS, "no json"])], "doc_key int, j string").select("doc_key", F.try_parse_json("j").alias("doc"))
    got = sorted(tuple(r) for r in K.conformance(df, CONTRACT).collect())
    want = [(k, p, v) for k, j in enumerate(DOCS) for p, v in plain_violations(json.loads(j), CONTRACT)] + [(len(DOCS), "$", "no_json")]
    assert got == sorted(want)
    assert K.conformance(df.limit(0), CONTRACT).count() == 0


def test_identity_conflicts(spark):
    df = spark.createDataFrame([("publishers/p/series/s", "publishers/p/series/s"), ("publishers/p", "publishers/q"), ("publishers/p", "x")], "a string, b string")
    assert [r["b"] for r in I.identity_conflicts(df, "a", "b").collect()] == ["publishers/q"]


def record(**changes):
    base = {
        "review_report_version": "v1", "review_id": "r", "provenance": {"published_revision_id": "rev_1", "generated_vs_approved": {"state": "generated_publication", "generated_snapshot_revision_id": "g1"}},
        "generated_geometry": {"total_pages": 3, "panels": [
            {"panel_key": "x_1_12::p1", "bounds": {"x": 0.9, "y": 0.2, "width": 0.3, "height": 0.4}, "order": 4}, {"panel_key": "x_1_12::p1", "bounds": {"x": 0.1, "y": 0.2, "width": 0.3, "height": 0.4}, "order": 0},
            {"panel_key": "spread_1::p1", "bounds": [0, 0, 1, 1], "coordinate_space": "spread", "page_range": "1-2"}]},
        "approved_geometry": {
            "panel_order": {"12": ["x_1_12::p1"]}, "spread_artifacts": [], "spread_order": {"1-2": []}, "x_1_12::p1": {"x": 0.1, "y": 0.2, "width": 0.3, "height": 0.4, "deleted": True},
            "spread_1::p1": {"isSpreadPanel": True, "stage_geometry": {"x": 0, "y": 0, "width": 1, "height": 1}, "page_range": "1-2"}},
        "generated_metadata": {"llm_enrichment_output_version": "v2", "llm_enrichment_outputs": [{
            "artifact_id": "a", "output": {"narrative": {"summary": "s"}, "classification": {"colors": ["r"], "tags": {"mood": "m"}}}, "field_sources": {"output.narrative.summary": "human", "output.classification.colors": "llm"}, "origin": None,
            "metadata_generation_provenance": "fresh", "generation_provenance": {"model": "m1", "prompt_version": ""}, "publisher_notes": "n",
            "context_source": [{"kind": "supporting_material", "material_id": "m", "files": [{"file_id": "z", "revision": 1}, {"file_id": "a", "revision": "2"}]}, {"kind": "registry_entity", "material_id": "q"}, {"kind": "supporting_material"}]}]},
        "approved_metadata": {"llm_enrichment_output_version": "v1.1", "llm_enrichment_outputs": [{"artifact_id": "a", "output": {"classification": {"tags": ["x"]}}}]},
    }
    return base | changes


def adapted(spark, records):
    """Records by key: the report, or the report with an approval and a snapshot."""
    rows = [(k, *(json.dumps(x) if x is not None else None for x in (r if isinstance(r, tuple) else (r, None, None)))) for k, r in records.items()]
    df = spark.createDataFrame(rows, "review_key string, r string, a string, s string")
    return A.adapt(df.select("review_key", F.try_parse_json("r").alias("report"), F.try_parse_json("a").alias("approval"), F.try_parse_json("s").alias("snapshot")))


def test_a_record_is_adapted(spark):
    made = adapted(spark, {"k": (record(), {"platform_approval_version": "v1", "canonical_dataset_state": "platform_approved"}, {"generated_snapshot_version": "v1"})})
    assert made.rejected.count() == 0
    r = made.reviews.first()
    assert (r["review_id"], r["applicability"], r["generated_snapshot_revision_id"], r["certified_state"], r["total_pages"]) == ("r", "generated_publication", "g1", "platform_approved", 3)
    panels = {(p["side"], p["artifact_id"]): p for p in made.geometry.collect()}
    assert len(panels) == 4 and panels["generated", "x_1_12::p1"]["x"] == 0.1 and panels["approved", "x_1_12::p1"]["deleted"] and panels["approved", "x_1_12::p1"]["ord"] == 0
    assert panels["generated", "x_1_12::p1"]["page_scope"] == "12" and panels["approved", "spread_1::p1"]["is_spread"] and panels["approved", "spread_1::p1"]["w"] == 1.0
    leaves = {(m["side"], m["field"]): m for m in made.metadata.select("side", "field", F.to_json("value").alias("value"), "editorial", "has_origin", "origin").collect()}
    assert {f for s, f in leaves if s == "approved"} == set(A.LEAVES_V1) and {f for s, f in leaves if s == "generated"} == {*A.LEAVES_V2, "publisher_notes"}
    recorded = {f for (s, f), m in leaves.items() if not m["editorial"]}
    assert recorded == {"narrative.summary", "classification.colors", "publisher_notes"} and all(leaves["generated", f]["value"] is None for f in recorded)
    assert leaves["generated", "classification.tags.mood"]["value"] == '"m"' and leaves["generated", "entities.objects"]["has_origin"] and not leaves["approved", "narrative.summary"]["has_origin"]
    assert [(g["material_id"], g["revision"]) for g in made.grounding.collect()] == [("m", "a@2,z@1")]
    g = made.generators.first()
    assert (g["model"], g["prompt_version"], g["heterogeneous"]) == ("m1", None, False)


def test_records_that_cannot_be_read(spark):
    manual = {"published_revision_id": "r", "generated_vs_approved": A.MANUAL}
    geometry = record()["approved_geometry"]
    unknown = {"llm_enrichment_output_version": "v9", "llm_enrichment_outputs": []}
    approval = {"platform_approval_version": "v1", "canonical_dataset_state": "x"}
    without = lambda name: {k: v for k, v in record().items() if k != name}
    cases = {
        "fine": (record(), None), "manual": (record(provenance=manual, generated_geometry=None, generated_metadata=None), None), "none": (None, "no_json"), "version": (record(review_report_version="v2"), "review_report_version"),
        "id": (without("review_id"), "review_id"), "geometry": (record(approved_geometry=[]), "approved_geometry"), "told": (record(provenance={**manual, "generated_vs_approved": "x"}), "generated_vs_approved"),
        "half": (record(generated_geometry=None), "generated_side"), "both": (record(generated_metadata=unknown, approved_metadata=unknown), "metadata_version"), "skew": (record(generated_metadata=unknown), None),
        "approval": ((record(), approval | {"platform_approval_version": "v2"}, None), "platform_approval_version"), "snapshot": ((record(), approval, {"generated_snapshot_version": "v3"}), "generated_snapshot_version"),
        "member": (record(approved_geometry=geometry | {"odd": "x"}), "unknown_member"), "stage": (record(approved_geometry=geometry | {"s": {"isSpreadPanel": True}}), "stage_geometry"), "shape": (record(approved_geometry=geometry | {"s": {"z": 1}}), "unknown_geometry"),
        "bounds": (record(generated_geometry={"panels": [{"panel_key": "k", "bounds": [1, 2]}]}), "bounds"), "key": (record(generated_geometry={"panels": [{"bounds": [1, 2, 3, 4]}]}), "panel_key"), "panels": (record(generated_geometry={}), "panels"),
        "outputs": (record(approved_metadata={"llm_enrichment_outputs": "x"}), "outputs"), "artifact": (record(approved_metadata={"llm_enrichment_outputs": [{}]}), "artifact_id"),
    }
    made = adapted(spark, {k: r for k, (r, _) in cases.items()})
    assert {r["review_key"]: r["reason"] for r in made.rejected.collect()} == {k: why for k, (_, why) in cases.items() if why}
    good = {k for k, (_, why) in cases.items() if not why}
    for part in (made.reviews, made.geometry, made.metadata):
        assert {r["review_key"] for r in part.select("review_key").distinct().collect()} == good
    nothing = adapted(spark, {"x": None}).reviews
    assert nothing.count() == 0


def test_generators_agree_mix_or_are_old(spark):
    outs = lambda *models, **more: {"llm_enrichment_output_version": "v2", "llm_enrichment_outputs": [{"artifact_id": str(k), "metadata_generation_provenance": d, "generation_provenance": {"model": m}} for k, (m, d) in enumerate(models)], **more}
    cases = {
        "one": outs(("m1", "fresh"), ("m1", "fresh"), ("m2", "preserved_approved")), "mixed": outs(("m1", "fresh"), ("m2", "fresh")), "empty": outs(("", "fresh"), ("m3", "fresh")), "old": outs(enrichment_model="m4", model=""), "none": outs(("m1", None)),
    }
    got = {r["review_key"]: r for r in adapted(spark, {k: record(generated_metadata=m) for k, m in cases.items()}).generators.collect()}
    digest = "mixed:" + hashlib.sha256(b"m1|m2").hexdigest()[:12]
    assert {k: r["model"] for k, r in got.items()} == {"one": "m1", "mixed": digest, "empty": "m3", "old": "m4", "none": None}
    assert got["mixed"]["heterogeneous"] and not got["empty"]["heterogeneous"] and got["old"]["fresh_outputs"] == 0


def test_certified_states(spark):
    reviews = spark.createDataFrame([(1, True), (2, False), (3, True)], "review_id int, creator_approved boolean")
    states = A.certified_state(reviews, spark.createDataFrame([(3, "platform_approved")], "review_id int, state string"))
    assert {r["review_id"]: r["certified_state"] for r in states.collect()} == {1: "creator_approved", 2: "draft", 3: "platform_approved"}


def test_kinds_and_presence_by_path(spark):
    docs = ['{"a": {"b": [1, {"c": null}]}}', '{"a": "x"}', '{"a": null}', "[1]", "7", "null", '{"a": []}', '{"a": {}}']
    v = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, d string").select("k", F.parse_json("d").alias("v"))
    got = v.orderBy("k").select(X.kind("v"), X.kind("v", "$.a"), X.has("v", "$.a"), X.is_list("v", "$.a.b"), X.kind(F.col("v"), "$.a.b[1].c"), X.canonical(F.col("v")))
    assert [tuple(r) for r in got.collect()] == [
        ("object", "object", True, True, "null", "a=b=1\nc="), ("object", "string", True, False, None, "a=x"), ("object", "null", True, False, None, "a="), ("array", None, False, False, None, "1"),
        ("integer", None, False, False, None, "7"), ("null", None, False, False, None, ""), ("object", "array", True, False, None, "a="), ("object", "object", True, False, None, "a="),
    ]


def test_shared_documents_are_not_split_into_columns(spark, tmp_path):
    rows = spark.range(2000).select("id", F.parse_json(F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit("}"))).alias("v"))
    kept = shared_table(rows, "documents")
    assert kept.where(F.variant_get("v", "$.n", "long") == F.col("id")).count() == 2000
    file = kept.inputFiles()[0].removeprefix("file://")
    assert len(pq.ParquetFile(file).schema) == 3  # id, value and metadata


def test_lines_are_dealt_by_order_once(spark, sf):
    plan = review_plans.reports(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and plan.count("lineitem.parquet") == 1


def test_values_of_a_small_file_are_dealt_out(spark, sf):
    assert review_plans.value_categories(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_parts_stay_in_their_review(spark):
    out = lambda a, text: {"artifact_id": a, "output": {"narrative": {"summary": text}}}
    meta = {"llm_enrichment_output_version": "v2", "llm_enrichment_outputs": [out("a", "1"), out("b", "2"), out("a", "3"), out(None, "4"), out(None, "5")]}
    bounds = {"x": 0, "y": 0, "width": 1, "height": 1}
    twice = {"panels": [{"panel_key": "k", "bounds": [1]}, {"panel_key": "k", "bounds": bounds}, {"panel_key": "l", "bounds": bounds}]}
    made = adapted(spark, {"k": record(generated_metadata=meta), "bad": record(generated_geometry=twice)})
    assert [tuple(r) for r in made.rejected.collect()] == [("bad", "bounds", "k")]  # the earlier of two panels cannot be read
    plan = made.metadata._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = made.metadata.where("side = 'generated' and field = 'narrative.summary'").select("artifact_id", F.to_json("value").alias("v")).collect()
    assert sorted(map(tuple, got), key=repr) == [("a", '"3"'), ("b", '"2"'), (None, '"5"')]


def test_lines_of_reviews_take_tasks_by_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert review_plans._lines(spark, sf).rdd.getNumPartitions() == -(-rows // 500)


def test_leaves_of_an_output_are_told_in_its_row(spark, sf):
    plan = review_plans.adapted_metadata(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_odd_members_and_flags(spark):
    box = {"x": 0.1, "y": 0.2, "width": 0.3, "height": 0.4}
    map_ = {"list": [1, 2], "null": None, "flag": box | {"isSpreadPanel": "yes"}, "off": box | {"isSpreadPanel": None}, "no": {"isSpreadPanel": False, "x": None}, "stage": {"isSpreadPanel": 1, "stage_geometry": [0, 0, 1, 1]}}
    made = adapted(spark, {"k": record(approved_geometry=map_), "fine": record(approved_geometry={n: map_[n] for n in ("off", "no")})})
    assert {tuple(r) for r in made.rejected.collect()} == {("k", "unknown_member", "list"), ("k", "unknown_member", "null"), ("k", "stage_geometry", "flag"), ("k", "stage_geometry", "stage")}
    assert {r["artifact_id"]: r["is_spread"] for r in made.geometry.where("side = 'approved'").collect()} == {"off": False, "no": False}


def test_documents_of_a_contract_take_tasks_by_their_lines(spark, sf, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    plan = review_plans.contract_violations(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(l_orderkey" in plan and f", {-(-rows // 500)}), REPARTITION_BY_NUM" in plan and plan.count("lineitem.parquet") == 1


def test_values_are_paired_in_their_row(spark):
    out = lambda a, text, **more: {"artifact_id": a, "output": {"narrative": {"summary": text}}} | more
    meta = lambda version, *outs: {"llm_enrichment_output_version": version, "llm_enrichment_outputs": list(outs)}
    generated = (out("b", {"t": [1]}, origin=None), out("a", "1"), out(None, "2"), out("c", "x"), out("a", "3", field_sources={"output.narrative.summary": "human"}))
    approved = (out("c", "y", publisher_notes="n"), out("a", "1"), out("b", {"t": [2]}), out(None, "2"), out("d", "z"))
    made = adapted(spark, {f"{v} {w}": record(generated_metadata=meta(v, *generated), approved_metadata=meta(w, *approved)) for v, w in (("v1", "v1"), ("v2", "v2"), ("v1.1", "v2"), ("v2", "v1"))} | {"none": record(approved_metadata=meta("v1"))})
    plan = made.value_pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    rows = lambda df: sorted((tuple(r) for r in df.withColumns({n: F.to_json(n) for n in ("generated_value", "approved_value")}).collect()), key=repr)
    want = E.paired_values(made.metadata)
    assert made.value_pairs.columns == want.columns and rows(made.value_pairs) == rows(want) and len(rows(want)) > 50


def test_equal_values_are_not_rendered(spark):
    pairs = spark.createDataFrame([('{"b":[1,"x"],"a":{}}', '{"a":{},"b":[1,"x"]}'), ('"s"', '"s"'), ("1e0", "1"), ("[1]", "[2]")], "g string, a string")
    got = pairs.select(X.measures(F.parse_json("g"), F.parse_json("a")).alias("m")).select("m.*")
    assert [tuple(r) for r in got.collect()] == [
        (0.0, 0.0, 0.0, 1.0, True, "object", "object"), (0.0, 0.0, None, 1.0, True, "string", "string"), (0.666667, 1.0, None, 0.333333, False, "number", "integer"), (1.0, 1.0, 1.0, 1.0, False, "array", "array"),
    ]


def test_materials_are_told_in_their_row(spark):
    out = lambda a, source: {"artifact_id": a, "output": {}, "context_source": source}
    one = {"kind": "supporting_material", "material_id": 7, "files": [{}, "x", None, {"file_id": "b", "revision": 2.5}, {"file_id": "a"}]}
    sources = [("a", [one]), ("b", [one, {"kind": "supporting_material", "material_id": ""}, "x", None, {"material_id": "m"}]), ("a", [{"kind": "supporting_material", "material_id": "n", "files": {"file_id": "a"}}]), ("c", {"kind": "x"}), ("d", None)]
    meta = {"llm_enrichment_output_version": "v1", "llm_enrichment_outputs": [out(*s) for s in sources]}
    made = adapted(spark, {"k": record(generated_metadata=meta, approved_metadata=meta | {"llm_enrichment_outputs": []})})
    plan = made.supported._jdf.queryExecution().executedPlan().toString()
    assert "variant" not in made.supported.schema.simpleString() and "Exchange" not in plan and "Join" not in plan
    assert sorted((r["artifact_id"], len(r["materials"])) for r in made.supported.collect()) == [("a", 1), ("b", 1), ("c", 0), ("d", 0)]
    assert sorted((g["artifact_id"], g["material_id"], g["revision"]) for g in made.grounding.collect()) == [("a", "n", ""), ("b", "7", "None@None,a@None,b@2.5")]


def test_the_gate_walks_a_report_once(spark):
    df = spark.createDataFrame([("k", json.dumps(record()))], "review_key string, r string").select("review_key", F.try_parse_json("r").alias("report"), *[F.lit(None).cast("variant").alias(n) for n in ("approval", "snapshot")])
    plan = A.gate(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.review_report_version") == 0 and plan.count("$.generated_metadata.llm_enrichment_output_version") == 0 and plan.count("AS _head#") == 1


def test_odd_heads_keep_their_reasons(spark):
    own = lambda **c: record()["provenance"] | c
    odd = {
        "review_report_version": record(review_report_version=None), "provenance.published_revision_id": record(provenance="x"), "provenance.generated_vs_approved": record(provenance={"published_revision_id": None}),
        "generated_vs_approved": record(provenance=own(generated_vs_approved=None)), "approved_geometry": record(approved_geometry=[]), "approved_metadata": record(approved_metadata=None),
        "generated_side": record(generated_geometry=None), "generated_metadata": record(generated_metadata="x"),
    }
    fine = {"null id": record(review_id=None), "list": record(generated_geometry={"panels": [], "total_pages": "x"}), "by hand": record(provenance=own(generated_vs_approved=A.MANUAL))}
    made = adapted(spark, odd | fine)
    assert {(r["review_key"], r["reason"]) for r in made.rejected.collect()} == {(k, k) for k in odd}
    assert {(r["review_key"], r["review_id"], r["applicability"], r["total_pages"]) for r in made.reviews.collect()} == {("null id", None, A.GENERATED, 3), ("list", "r", A.GENERATED, None), ("by hand", "r", "manual", 3)}


def test_places_are_told_in_their_row(spark):
    box = {"x": 0.1, "y": 0.2, "width": 0.3, "height": 0.4}
    orders = {"1": ["a", "b", "a", None, "lost"], "2": ["c", "b"], "10": None, "3": []}
    made = adapted(spark, {"k": record(approved_geometry={"panel_order": orders} | {n: box for n in ("d", "c", "b", "a")}), "none": record(approved_geometry={"a": box}), "list": record(approved_geometry={"panel_order": ["a"], "a": box}), "empty": record(approved_geometry={})})
    panels = made.geometry.where("side = 'approved'")
    plan = panels._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {(p["review_key"], p["artifact_id"]): p["ord"] for p in panels.collect()} == {("k", "a"): 2, ("k", "b"): 1, ("k", "c"): 0, ("k", "d"): None, ("none", "a"): None, ("list", "a"): None}


def test_tasks_list_and_read_a_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "STEPS", 2)
    monkeypatch.setattr(I, "BATCH_ROWS", 3)
    monkeypatch.setattr(I, "BATCH_BYTES", 5)
    want = {f"{PREFIX.format(k)}/approved/published.json": b"x" * (k + 1) for k in range(9)} | {"top.json": b"t", "a b/c%20d/\u00e9.json": b"e", "_p=1/kept": b"k"}
    for path, content in (want | {"_gone/f": b"1", ".gone": b"1", "a b/f._COPYING_": b"1", "a b/empty": b""}).items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    (tmp_path / "no/files").mkdir(parents=True)
    root = f"file://{tmp_path}"
    listed = I.listed_files(spark, root)
    assert sorted(map(tuple, listed.collect())) == sorted((p, len(c)) for p, c in want.items())
    assert {r["path"]: bytes(r["content"]) for r in I.read_files(I.dealt_files(listed, 12, "path"), root).collect()} == want
    (tmp_path / "no").rename(tmp_path / "alone")
    assert I.listed_files(spark, f"file://{tmp_path}/alone").count() == 0


def test_pointers_are_read_once_and_listed_by_tasks(spark, sf):
    plan = ingest_plans.scanned_issues(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "binaryFile" not in plan and "Broadcast" not in plan


def test_plain_values_are_read_off_their_json(spark, monkeypatch):
    monkeypatch.setattr(X, "_opened", lambda item: F.array(F.struct(F.lit("opened").alias("lead"), item["value"].alias("value"))).cast(X._ITEMS))
    values = {
        '[{"name": "x", "line": ["a:,", "b\\n\\"\\\\n{"]}, null, {}, [], 1.50, true]': 'line=a:,\nb\n"\\n{\nname=x\n\n\n\n1.5\ntrue', '{"b": {"c": null}, "a": [["x"], "null"]}': "a=x\nnull\nb=c=",
        '"plain"': "plain", '"a\\tb"': "a\tb", "null": "", "[]": "", "2": "2", '"\U0001f600"': "\U0001f600", None: "",
    }
    df = spark.createDataFrame([(k, v) for k, v in values.items()] + [('["\\u0001"]', "opened")], "j string, want string").withColumn("v", F.try_parse_json("j"))
    got = df.select("want", X.canonical(F.col("v")).alias("got"), X.json_text(F.col("v")).eqNullSafe(F.to_json("v")).alias("same")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got] and all(r["same"] for r in got)


def _odd_sides(spark):
    out = lambda a, text, **more: {"artifact_id": a, "output": {"narrative": {"summary": text, "dialogue": [{"name": text, "line": [1, {}]}]}, "entities": {"characters": more.pop("who", [])}}} | more
    meta = lambda version, *outs: {"llm_enrichment_output_version": version, "llm_enrichment_outputs": list(outs)}
    generated = (out("b", {"t": [1]}, origin=None), out("a", "1"), out(None, "2"), out("c", "x\"y"), out("a", "3 abc", field_sources={"output.narrative.summary": "human"}, who="w"), out("e", 1.0), out("f", "same"))
    approved = (out("c", "y", publisher_notes="n"), out("a", "3 abd"), out("b", {"t": [2]}), out(None, "2"), out("d", "z"), out("e", 1), out("f", "same"))
    return adapted(spark, {f"{v} {w}": record(generated_metadata=meta(v, *generated), approved_metadata=meta(w, *approved)) for v, w in (("v1", "v1"), ("v2", "v2"), ("v1.1", "v2"))} | {"none": record(approved_metadata=meta("v1")), "bad": record(approved_geometry=[])})


def test_leaves_are_stored_as_text(spark):
    made = _odd_sides(spark)
    own = ["review_key", "side", "artifact_id", "schema_version", "generation_disposition", "origin", "has_origin"]
    assert "variant" not in made.leaf_texts.schema.simpleString()
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    value = F.col("leaf.value")
    want = made.leaves.select(*own, F.explode("leaves").alias("leaf")).select(*own, "leaf.field", "leaf.editorial", F.to_json(value).alias("json"), F.when(F.col("leaf.editorial"), X.canonical(value)).alias("text"))
    assert rows(made.leaf_texts.select(*own, F.inline("leaves"))) == rows(want) and want.count() > 100


def test_pairs_are_judged_in_their_row(spark):
    made = _odd_sides(spark)
    names = ["review_id", "artifact_id", "field", "status", "disposition", "origin", "has_origin", *E.JUDGED]
    judged = made.judged_pairs(E.judge_values, *E.JUDGED)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert judged.columns == names and "Exchange" not in plan and "Join" not in plan and "variant" not in judged.schema.simpleString()
    rows = lambda df: sorted((tuple(r) for r in df.select(names).collect()), key=repr)
    want = rows(E.classify_values(made.value_pairs))
    assert rows(judged) == want and len({r[7] for r in want}) > 5
    assert made.reviews.count() == 4 and made.generators.count() == 4 and "judgements" not in made.reviews.columns


def test_tables_by_review_are_not_broadcast(spark, sf):
    for query in (review_plans.review_benchmark, report_plans.acceptance_by_generator):
        assert "Broadcast" not in query(spark, sf)._jdf.queryExecution().executedPlan().toString()
