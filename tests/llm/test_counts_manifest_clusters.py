"""Token counts, the Merkle manifest and centroid clustering against plain versions, on the small tables and on odd rows."""

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import clustering, merkle, queries, token_counts

LONG = " ".join(f"w{k}" for k in range(30_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "", None, 6), (4, "one two three", "en", "a", 13), (4, "one two three", "en", "a", 13), (5, "one two three", None, "b", None),
    (None, "no id at all here", "de", "b", 17), (None, "no id either", "de", "b", 12), (6, LONG, "en", "a", 9), (7, "é😀 ünï " * 60, "fr", "c", (1 << 63) - 1), (8, "a" * 5000, "en", "c", 5000),
    (9, "x <|endoftext|> Ünïcode ½ café's don't stop.\x1c ok “quoted” ΣΑΣ   á <|x|>", "en", "d", 1), (10, "tab\tand\rreturn\vand\ffeed\n\n end", "zz", "d", 1), (6, "same id, other text", "en", "a", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    names = ("n_tokens", "run", "key", "hash", "extra", "tie", "at", "part", "pos", "block", "children", "piece", "n", "leaf", "y", "x", "cluster")
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in names}).repartition(3)


def whole(name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return path, lambda text: len(model.encode(text or ""))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return path, lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_token_counts(spark, docs, odd, sf):
    path, count = whole("word_bpe_49k.json")
    for frame in (docs, odd):
        out = token_counts.count_tokens(frame, path)
        assert out.columns == [c for c in frame.columns if c != "n_tokens"] + ["n_tokens"]
        rows = out.collect()
        assert len(rows) == frame.count() and all(r["n_tokens"] == count(r["text"]) for r in rows)
    assert token_counts.count_tokens(odd.limit(0), path).count() == 0
    for r in token_counts.op11_token_counts(spark, sf).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 2048)


@pytest.mark.parametrize("table", [[], ["the", "", "not a piece", "of", "x" * 40]])
def test_the_table_never_changes_a_count(docs, odd, table):
    path, count = whole("word_bpe_49k.json")
    for frame in (docs.limit(50), odd):
        assert all(r["n_tokens"] == count(r["text"]) for r in token_counts.count_tokens(frame, path, table=table).collect())


def test_small_parts_and_a_full_cache_change_nothing(docs, monkeypatch):
    path, count = whole("word_bpe_49k.json")
    texts = [r["text"] for r in docs.limit(40).collect()] + [r[1] for r in ODD]
    monkeypatch.setattr(token_counts, "CACHE_CHARACTERS", 100)
    monkeypatch.setattr(token_counts, "parts", lambda text: list(_parts(text, 64)))
    counter = token_counts.PieceCounter(path, "the\nof", bytes([1, 1]))
    assert [counter(t or "") for t in texts] == [count(t) for t in texts]


_parts = token_counts.parts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_read_whole_texts(docs, odd, name):
    path, count = whole(name)
    assert not token_counts.separable(path)
    for frame in (docs.limit(20), odd):
        assert all(r["n_tokens"] == count(r["text"]) for r in token_counts.count_tokens(frame, path).collect())


def test_frequent_pieces(docs):
    counts = collections.Counter(p for r in docs.collect() for p in token_counts.pre_tokens(r["text"] or "")[0])
    found = token_counts.frequent_pieces(docs, entries=50)
    assert sorted(counts[p] for p in found) == sorted(n for _, n in counts.most_common(50))
    small = token_counts.thinned(counts, 100)
    assert len(small) <= 100 and all(counts[p] - counts.total() / 100 <= n <= counts[p] for p, n in small.items())
    assert all(p in small for p, n in counts.items() if n > counts.total() / 100)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    """All levels."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_proof(levels, at):
    out = []
    for level in levels[:-1]:
        beside = at ^ 1
        out.append(("L" if at % 2 else "R") + level[beside] if beside < len(level) else "")
        at //= 2
    return out


def plain_fold(leaf, proof):
    for s in proof:
        leaf = digest(s[1:] + leaf if s.startswith("L") else leaf + s[1:])
    return leaf


def plain_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: digest("".join(map(enc, (r["doc_id"], r["source"], r["lang"], n, r["text"]))))
    runs = collections.defaultdict(list)
    for r in rows:
        runs[r["lang"]].append(((r["doc_id"] is not None, r["doc_id"] or 0), leaf(r, r["n_chars"]), r))
    order = sorted(runs, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: plain_tree([h for _, h, _ in sorted(runs[k], key=lambda x: x[:2])]) for k in order}
    top = plain_tree([trees[k][-1][0] for k in order])
    out = []
    for i, k in enumerate(order):
        for at, (_, h, r) in enumerate(sorted(runs[k], key=lambda x: x[:2])):
            proof = plain_proof(trees[k], at) + plain_proof(top, i)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            folded = plain_fold(leaf(r, r["n_chars"] + 1) if hit else h, proof)
            out.append((r["doc_id"], h, trees[k][-1][0], top[-1][0], digest("".join(s[1:] for s in proof)), folded, folded == top[-1][0]))
    return out


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_merkle_manifest(spark, docs, odd, tmp_path):
    for k, frame in enumerate((docs, odd, odd.where("doc_id = 10"))):
        folder = str(tmp_path / f"t{k}")
        frame.write.parquet(f"{folder}/documents.parquet")
        got = merkle.op12_merkle_manifest(spark, folder).collect()
        same(got, plain_manifest(frame.collect()))
        assert any(not r["verified"] for r in got) == any(r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 for r in frame.collect())
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert merkle.op12_merkle_manifest(spark, str(tmp_path / "none")).count() == 0
    assert merkle.manifest(docs.limit(0)).root is None


@pytest.mark.parametrize("stride", [1, 2, 5])
def test_strides_do_not_change_the_tree(docs, odd, stride):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    made = merkle.manifest(rows, stride=stride)
    want = plain_manifest(rows.collect())
    assert {made.root} == {w[3] for w in want}
    got = made.proofs().select("key", "hash", "subroot", F.sha2(F.array_join(F.transform("proof", lambda s: F.substring(s, 2, 64)), ""), 256).alias("p"), merkle.fold(F.col("hash"), F.col("proof")).alias("f")).collect()
    assert {r["f"] for r in got} == {made.root}
    same([r[:4] for r in got], [(w[0], w[1], w[2], w[4]) for w in want])


def plain_clusters(rows, clusters=40, rounds=5, width=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [a * 256 // b for a, b in (float(x).as_integer_ratio() for x in v)]))
    centroids = [q for _, q in sorted((digest(f"2:{i}"), q) for i, q in kept if i is not None)[:clusters]]
    apart = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    near = lambda q: min((apart(q, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, q in kept:
            groups[near(q)[1]].append(q)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if groups[k] else c for k, c in enumerate(centroids)]
    return [(i, near(q)[1], min(near(q)[0], (1 << 63) - 1)) for i, q in kept] if centroids else [], centroids


VECTORS = [
    (1, [0.5, -0.25, 1.0, 0.0]), (2, [0.5, -0.25, 1.0, -0.0]), (2, [3.0, 2.0, 1.0, 9.0]), (3, None), (4, [1.0, None, 0.0, 0.0]), (5, [1.0, 2.0]), (6, [float("nan"), 0.0, 0.0, 0.0]), (7, [float("inf"), 0.0, 0.0, 0.0]),
    (8, []), (None, [0.1, 0.2, 0.3, 0.4]), (9, [-1e-9, 1e-9, -0.004, 0.004]), (10, [0.5, -0.25, 1.0, 0.0]), (10, [0.5, -0.25, 1.0, 0.0]), (11, [7.0, 7.0, -7.0, 7.0]),
]
HUGE = [(20, [1e300, -1e300, 0.3, 5e15]), (21, [1e300, -1e290, 0.3, 5e15]), (22, [2.0**70, 1.0, 1.0, 1.0]), (23, [3e6, -3e6, 3e6, -3e6])]


@pytest.mark.parametrize("rows", [VECTORS, VECTORS + HUGE, HUGE, VECTORS[2:9]], ids=["odd", "huge too", "huge", "few"])
def test_clusters_of_odd_vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("y", "cluster", "codes", "hash", "dim")}).repartition(3)
    for clusters, block, chunk in ((3, 2, 4), (40, 3, 2), (2, 1, 100)):
        assigned, centroids = clustering.cluster(frame, clusters, width=4, block=block, chunk=chunk)
        want, ends = plain_clusters(rows, clusters, width=4)
        same(assigned.collect(), want)
        assert centroids == ends


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([(1, [0.0]), (2, None)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert clustering.op13_centroid_clusters(spark, str(tmp_path)).count() == 0


def test_dictionaries_lose_nothing(spark, sf):
    vectors = clustering.grid(spark.read.parquet(f"{sf}/embeddings.parquet"))
    want = {r["vec_id"]: [math.floor(256 * x) for x in r["y"]] for r in vectors.collect()}
    for batch in clustering.encode(vectors, chunk=100).toArrow().to_batches():
        for ids, parts in clustering._pages(batch, 64, 2, 256):
            rows = np.concatenate([entries[code] for _, entries, code in parts], axis=1)
            assert all(want[i] == q for i, q in zip(ids, rows.tolist()))
            assert all(len(np.unique(entries, axis=0)) == len(entries) for _, entries, _ in parts)


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_centroid_clusters", "quality_rule_ablations"])
def test_matches_sql(spark, sf, name):
    ours = queries.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    theirs = con.execute(queries.oracle_sql()[name])
    assert ours.columns == [c[0] for c in theirs.description]
    same(ours.collect(), theirs.fetchall())
