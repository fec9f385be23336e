"""The pipeline on the small tables against a plain version of its stages."""

import collections

import __spark_entry__
import corpus_pipeline
from folioscope.llm import quality
from folioscope.llm.common import shared_table
from test_llm import BASE, WORD, brute_near, brute_quality, brute_targets, check_pieces


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(shared_table(stage(spark, out[-1], sf), name))
        if name != "pack_sequences":
            assert out[-1].columns == docs.columns
    rows = [sorted((tuple(r) for r in o.select("doc_id", "text", "source").collect()), key=repr) for o in out[:-1]]
    base = [r for r in rows[0] if brute_quality(r[1])[0] >= 20 and 100 * brute_quality(r[1])[4] <= 30 * brute_quality(r[1])[0]]
    assert set(rows[1]) <= set(base) and len(rows[1]) > 0.8 * len(base)
    again = quality.annotate(docs).where(quality.verdict(quality.F.col("ledger.failed"))).count()
    assert len(rows[1]) == again
    firsts = {c for _, c, _ in brute_near([r[:2] for r in rows[1]])}
    assert {r[0] for r in rows[2]} == firsts and len(rows[2]) == len(firsts)
    assert len(rows[3]) == len(rows[2])
    for r in rows[3]:
        assert not any(ok(m) for p, ok in BASE for m in p.finditer(r[1]))
    size = collections.Counter()
    for r in rows[3]:
        size[r[2]] += len(WORD.findall(r[1]))
    taken = collections.Counter()
    for r in rows[4]:
        taken[r[2]] += len(WORD.findall(r[1]))
    want = brute_targets(dict(size))
    assert set(rows[4]) <= set(rows[3])  # whole texts
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in size)
    pieces = out[-1].collect()
    assert sum(r["length"] for r in pieces) == sum({(r["doc_id"], r["sequence_id"], r["offset"]): r["length"] for r in pieces}.values())
    check_pieces(pieces, [r[:2] for r in rows[4]])


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}


def test_stages_on_odd_rows_and_none(spark, sf):
    """Null ids, texts and sources, repeated rows, clashing names, and an empty table."""
    words = lambda k: " ".join(f"w{k}_{i}" for i in range(30))
    rows = [(1, words(1), None), (1, words(1), None), (2, words(1), "a"), (None, words(2), "b"), (None, None, None), (3, None, "a"), (4, "", "a"), (5, words(3) + " token=abcdef123", None), (6, "few words", "b")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'clash' _ledger", "'clash' _mix", "'clash' _key", "'clash' quota_source")
    docs, kept = table, []
    for name, stage in corpus_pipeline.STAGES:
        docs = shared_table(stage(spark, docs, sf), name)
        kept.append(docs.collect())
        if name != "pack_sequences":
            assert docs.columns == table.columns and all(r["_ledger"] == r["_mix"] == r["_key"] == r["quota_source"] == "clash" for r in kept[-1])
    assert sorted(str(r["doc_id"]) for r in kept[0]) == ["1", "1", "2", "5", "None"]
    assert sorted(str(r["doc_id"]) for r in kept[1]) == ["1", "5", "None"]
    assert [r["text"] for r in kept[2] if r["doc_id"] == 5] == [words(3) + " [secret]"]
    assert {r["doc_id"] for r in kept[3]} <= {1, 5, None} and sum(r["length"] for r in kept[4]) > 0
    docs = table.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = shared_table(stage(spark, docs, sf), name)
        assert docs.count() == 0
