"""Exact top-k search by inner product: longest vectors first, rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import shared_table

SCALE = 64
K = 20
#: Every vector whose id is divisible by this is a query.
QUERY_STEP = 20
#: Queries and candidates that meet in one group on average, and candidates compared at a time.
QUERY_BLOCK, CANDIDATE_BLOCK, CHUNK = 4096, 16_384, 2048
#: Longest vectors, against which every query gets its first threshold.
SEEDS = 1024
MAX_RANGES = 10_000
#: Leading rotated components of the partial sums, as shares of all.
HEADS = (0.125, 0.25, 0.5)


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q, norm2): whole-number vectors, one per id.

    Rows without an id or vector, or with a component that is null, NaN or infinite, drop out; an empty
    vector stays and scores 0. Components beyond the range of a long are held at its ends. An id that
    occurs again keeps its least vector.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    held = lambda x: F.when(x >= float(1 << 63), F.lit((1 << 63) - 1)).when(x <= -float(1 << 63), F.lit(-(1 << 63))).otherwise(F.floor(x).cast("long"))
    able = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite))
    whole = able.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: held(x.cast("double") * scale)).alias("q"))
    one = whole.groupBy("vec_id").agg(F.min("q").alias("q"))
    return one.withColumn("norm2", F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.array(column.offsets, np.int64)) if len(column) else np.zeros(0, np.int64)
    flat = np.array(column.flatten(), np.int64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Orthogonal axes by descending share of all vectors' energy: right singular vectors, from the Gram matrix."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column("q"), width).astype(float)
            total += m.T @ m
        i, j = np.indices((width, width))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "x"])

    cells = vectors.select("q").mapInArrow(gram, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((width, width))
    for c in cells:
        total[c["i"], c["j"]] = c["x"]
    return np.linalg.eigh(total)[1][:, ::-1]


def best_of_group(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, found: np.ndarray, ids: np.ndarray, axes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of each query's k best among ``found``, of which none below ``floor`` is needed.

    Candidates come longest first. A chunk is left out for queries whose length times the chunk's
    greatest length stays below their threshold. Of the rest, pairs whose partial sum over the leading
    axes plus the product of the residual lengths stays below it are not multiplied out; this is asked at each of
    HEADS, and a query or candidate without any pair left takes no part in the longer sums.
    """
    order = np.argsort(-(found.astype(float) ** 2).sum(1), kind="stable")
    found, ids = found[order], ids[order]
    most = np.abs(queries.astype(float)).max(initial=0) * np.abs(found.astype(float)).max(initial=0) * found.shape[1]
    kind = float if most < 2.0**52 else np.int64 if most < 2.0**62 else object  # the narrowest that holds every score exactly
    q_exact, c_exact = queries.astype(kind), found.astype(kind)
    whole = (lambda x: np.rint(x).astype(np.int64)) if kind is float else (lambda x: x)
    q_turned, c_turned = queries @ axes, found @ axes
    heads = sorted({max(1, int(share * axes.shape[1])) for share in HEADS})
    q_len, c_len = np.linalg.norm(q_turned, axis=1), np.linalg.norm(c_turned, axis=1)
    rests = [(np.linalg.norm(q_turned[:, h:], axis=1), np.linalg.norm(c_turned[:, h:], axis=1)) for h in heads]
    slack = 1e-6 * (1 + q_len.max(initial=0) * c_len.max(initial=0))  # for rounding of the floating-point bounds
    level = floor.astype(float).copy()
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object if kind is object else np.int64)]
    for at in range(0, len(ids), CHUNK):
        part = np.arange(at, min(at + CHUNK, len(ids)))
        rows = np.flatnonzero(q_len * c_len[at] + slack >= level)
        if not len(rows):
            break  # all later candidates are shorter
        sums, done = np.zeros((len(rows), len(part))), 0
        for head, (q_rest, c_rest) in zip(heads, rests):
            sums += q_turned[rows, done:head] @ c_turned[part, done:head].T
            able = sums + np.outer(q_rest[rows], c_rest[part]) + slack >= level[rows][:, None]
            some, any_of = able.any(axis=1), able.any(axis=0)
            if not (some.all() and any_of.all()):
                rows, part, sums, able = rows[some], part[any_of], sums[some][:, any_of], able[some][:, any_of]
            done = head
        i, j = np.nonzero(able)
        if len(i) > 0.1 * able.size:
            score = whole((q_exact[rows] @ c_exact[part].T)[i, j])
        else:
            score = np.concatenate([kept[2][:0]] + [whole((q_exact[rows[i[a : a + 65536]]] * c_exact[part][j[a : a + 65536]]).sum(1)) for a in range(0, len(i), 65536)])
        q, c = rows[i], ids[part][j]
        good = (score.astype(float) + slack >= level[q]) & (c != query_ids[q])
        q, c, score = (np.concatenate([a, b[good]]) for a, b in zip(kept, (q, c, score)))
        by = np.lexsort((c, -score, q)) if kind is not object else np.array(sorted(range(len(q)), key=lambda k: (q[k], -score[k], c[k])), np.int64)
        q, c, score = q[by], c[by], score[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < k
        kept = [q[top], c[top], score[top]]
        last = place[top] == k - 1
        level[kept[0][last]] = np.maximum(level[kept[0][last]], kept[2][last].astype(float))
    return kept[0], kept[1], kept[2]


#: Scores leave the groups as decimals where a product of two components may pass a long's range.
_WIDE = "decimal(38,0)"
_MOST = 10**38 - 1


def _splits(values: DataFrame, column: str, parts: int) -> list[float]:
    """At most parts - 1 ascending values that cut a column into ranges of about equal number."""
    if parts < 2:
        return []
    return sorted(set(values.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10 * parts + 1000)).first()[0]))


def _slot(splits: list[float], value: Column) -> Column:
    """The number of splits below ``value``."""
    return F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s < value)) if splits else F.lit(0)


#: What a group of queries and candidates is told by.
_KEYS = ("block", "qp", "slot", "cp")


def deal(whole: DataFrame, count: int, width: int, k: int, query_step: int) -> tuple[DataFrame, DataFrame]:
    """Queries (with ``floor``, which their k best reach) and candidates, each once for every group (_KEYS) it meets in."""
    alike = Window.partitionBy("q").orderBy("vec_id")
    distinct = whole.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k + 1).drop("_n")
    # less than one is added, so that vectors of equal length can be told apart; shorter than ``spot`` means below a split
    distinct = distinct.withColumn("spot", F.sqrt("norm2") + F.shiftrightunsigned(F.xxhash64("vec_id"), 1) / float(1 << 63))
    seeds = distinct.orderBy(F.desc("spot"), "vec_id").limit(SEEDS).select("vec_id", "q").collect()
    seed_ids = np.array([r["vec_id"] for r in seeds], np.int64)
    seed_rows = _matrix(pa.array([r["q"] for r in seeds], pa.list_(pa.int64())), width).astype(float)
    needed = -(-count // CANDIDATE_BLOCK)
    splits = _splits(distinct, "spot", min(MAX_RANGES, needed))
    ranges = len(splits) + 1
    parts = -(-needed // ranges)  # beyond MAX_RANGES a range is dealt further by hash
    distinct = distinct.withColumn("slot", _slot(splits, F.col("spot")))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, ids = _matrix(batch.column("q"), width).astype(float), np.array(batch.column("vec_id"), np.int64)
            floor, least = np.full(len(q), -np.inf), np.zeros(len(q))
            if len(seed_ids) > k:
                first = q @ seed_rows.T
                first[ids[:, None] == seed_ids] = -np.inf
                error = 1e-9 * (1 + np.linalg.norm(q, axis=1) * np.linalg.norm(seed_rows, axis=1).max())
                floor = np.partition(first, -k, axis=1)[:, -k] - error
                length = np.linalg.norm(q, axis=1)
                least = np.where((floor > 0) & (length > 0), floor / np.maximum(length, 1e-300) * (1 - 1e-9), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.array(floor), pa.array(least)], names=["vec_id", "q", "floor", "least"])

    queries = whole.where(F.col("vec_id") % query_step == 0).select("vec_id", "q")
    queries = shared_table(queries.mapInArrow(floors, "vec_id long, q array<long>, floor double, least double"), "queries")
    # the longest lengths needed are dealt to the last blocks, which meet the fewest slots
    cuts = _splits(queries, "least", -(-queries.count() // QUERY_BLOCK))
    reach = queries.groupBy(_slot(cuts, F.col("least")).alias("b")).agg(F.count("*").alias("n"), F.min("least").alias("least")).collect()
    first_slot = {r["b"]: sum(s < r["least"] for s in splits) for r in reach}  # slots below hold lengths below all that are needed
    dealt = {r["b"]: -(-r["n"] // QUERY_BLOCK) for r in reach}  # equal needs are dealt by hash
    every = range(len(cuts) + 1)
    from_slot = F.array(*[F.lit(first_slot.get(b, ranges)) for b in every])
    query_parts = F.array(*[F.lit(dealt.get(b, 1)) for b in every])
    # block b meets slot s where from_slot[b] <= s; from_slot rises with b
    upto = F.array(*[F.lit(max([b for b in first_slot if first_slot[b] <= s], default=-1)) for s in range(ranges)])
    upto_n = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    left = queries.withColumn("block", _slot(cuts, F.col("least")))
    left = left.withColumn("qp", F.pmod(F.xxhash64("vec_id"), F.get(query_parts, F.col("block"))).cast("int"))
    left = left.withColumn("slot", F.explode(F.transform(upto_n(F.lit(ranges) - F.get(from_slot, F.col("block"))), lambda i: i + F.get(from_slot, F.col("block")))))
    left = left.withColumn("cp", F.explode(upto_n(F.lit(parts))))
    right = distinct.withColumn("cp", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(upto_n(F.get(upto, F.col("slot")) + 1)))
    right = right.withColumn("qp", F.explode(upto_n(F.get(query_parts, F.col("block")))))
    return left.select(*_KEYS, "vec_id", "q", "floor"), right.select(*_KEYS, "vec_id", "q")


def search(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with other vectors, ties to the smaller id.

    Queries are the vectors whose id is divisible by ``query_step``; candidates are all vectors with
    another id. Of equal vectors only the k + 1 smallest ids can ever be returned, so the others drop
    out first. Candidates are dealt by length into slots. The SEEDS longest vectors, a fixed number, give
    every query the score that its k best reach at least, and with it the shortest length that a candidate
    needs (Cauchy-Schwarz). Queries are dealt by that length into blocks, and a block meets only the
    slots that one of its queries needs, in groups of bounded size; what leaves a group is its k best.

    Components are floor(64 * x). See ``quantized`` for what takes no part; vectors of different
    lengths are filled up with zeros. Scores are exact; one beyond the range of a long is
    ranked by its value and returned as the range's end. No query, or no other vector: no row.
    """
    whole = shared_table(quantized(vectors), "vectors")
    count, width, most = whole.agg(F.count("*"), F.max(F.size("q")), F.max("norm2")).first()
    out = ("query_id", "rank", "vec_id", "score")
    if not count:
        return whole.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    wide = most >= 2.0**62
    schema = f"query_id long, vec_id long, score {_WIDE if wide else 'long'}"
    axes = rotation(whole, width)
    left, right = deal(whole, count, width, k, query_step)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        kind = pa.decimal128(38, 0) if wide else pa.int64()
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], kind)})
        q_ids = np.array(a.column("vec_id"), np.int64)
        at, ids, score = best_of_group(_matrix(a.column("q"), width), q_ids, np.array(a.column("floor"), float), _matrix(b.column("q"), width), np.array(b.column("vec_id"), np.int64), axes, k)
        scores = [Decimal(max(-_MOST, min(_MOST, int(x)))) for x in score.tolist()] if wide else score
        return pa.table({"query_id": pa.array(q_ids[at]), "vec_id": pa.array(ids), "score": pa.array(scores, kind)})

    pairs = left.groupBy(*_KEYS).cogroup(right.groupBy(*_KEYS)).applyInArrow(meet, schema)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    if wide:
        ranked = ranked.withColumn("score", F.greatest(F.lit(-(1 << 63)).cast(_WIDE), F.least(F.lit((1 << 63) - 1).cast(_WIDE), F.col("score"))).cast("long"))
    return ranked.select(*out)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors of every 20th one."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) q
           from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id query_id, b.vec_id, cast(list_inner_product(cast(a.q as double[]), cast(b.q as double[])) as bigint) score
      from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) k from s)
select query_id, cast(k as integer) "rank", vec_id, score from r where k <= 20
"""
