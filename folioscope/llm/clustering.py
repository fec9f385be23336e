"""Centroid clustering of whole-number vectors by dictionaries of their distinct subvectors."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import shared_table

SCALE, WIDTH = 256, 64
CLUSTERS, ROUNDS = 40, 5
#: Put before a vector's id for the hash that chooses the first centroids.
SEED = "2:"
#: Dimensions of one subvector, and vectors that share their dictionaries (65,536 at most: codes take two bytes).
BLOCK, CHUNK = 2, 1 << 14
#: Whole numbers below this leave the squared distance of 64 of them within 64 bits; larger ones are reckoned at any size.
SAFE = 1 << 27
#: Sums travel in digits of so many bits, so that adding them up never overflows.
DIGIT = 40
LONG = (1 << 63) - 1

_PAGE = "ids array<long>, codes binary, sizes array<int>, entries binary"


def grid(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, y) of the vectors that take part, with y = floor(scale * x) / scale of each component x as a double.

    ``scale`` is a power of two, so y is exact at any size. Vectors of another length and those with a null, NaN or
    infinite component drop out; a null id stays, and so does every row of a repeated one.
    """
    double = lambda x: x.cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(double(x)) & (F.abs(double(x)) < float("inf"))
    able = vectors.where(F.coalesce((F.size("embedding") == width) & F.forall("embedding", finite), F.lit(False)))
    # from 2**50 on a double is a multiple of a quarter
    floor = lambda x: F.when(F.abs(double(x)) < float(1 << 50), F.floor(double(x) * scale).cast("double") / scale).otherwise(double(x))
    return able.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", floor).alias("y"))


def _exact(y: np.ndarray, scale: int) -> np.ndarray:
    """scale * y as whole numbers: of 64 bits if all are safe, else Python's own."""
    if not y.size or np.abs(y).max() < SAFE / scale:
        return (y * scale).astype(np.int64)
    out = np.empty(y.size, object)
    for i, x in enumerate(y.ravel().tolist()):
        a, b = x.as_integer_ratio()
        out[i] = a * scale // b
    return out.reshape(y.shape)


def encode(vectors: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Pages of up to ``chunk`` vectors: for each block of dimensions the distinct subvectors, and every vector's code.

    Nothing is lost and nothing shuffled; a task holds one page. The dictionaries of a page grow with what is distinct
    in it, never with the table.
    """

    def page(ids: list, y: np.ndarray) -> pa.RecordBatch:
        codes, entries = [], []
        for at in range(0, y.shape[1], block):
            distinct, code = np.unique(y[:, at : at + block] + 0.0, axis=0, return_inverse=True)
            entries.append(distinct)
            codes.append(code.astype("<u2").ravel())
        blobs = [b"".join(c.tobytes() for c in codes), b"".join(e.astype("<f8").tobytes() for e in entries)]
        columns = [pa.array([ids], pa.list_(pa.int64())), pa.array(blobs[:1], pa.binary()), pa.array([[len(e) for e in entries]], pa.list_(pa.int32())), pa.array(blobs[1:], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "codes", "sizes", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                ids += part.column("vec_id").to_pylist()
                held.append(part.column("y").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                if len(ids) >= chunk:
                    y = np.concatenate(held)
                    yield page(ids[:chunk], y[:chunk])
                    ids, held = ids[chunk:], [y[chunk:]]
        if ids:
            yield page(ids, np.concatenate(held))

    return vectors.mapInArrow(run, _PAGE)


def _pages(batch: pa.RecordBatch, width: int, block: int, scale: int) -> Iterator[tuple[list, list[tuple[slice, np.ndarray, np.ndarray]]]]:
    """Each page's ids, and for each block its dimensions, its distinct subvectors as whole numbers, and the codes."""
    for ids, codes, sizes, entries in zip(*(batch.column(c).to_pylist() for c in ("ids", "codes", "sizes", "entries"))):
        code, values = np.frombuffer(codes, "<u2").reshape(len(sizes), len(ids)), np.frombuffer(entries, "<f8")
        parts, at = [], 0
        for k, n in enumerate(sizes):
            dims = slice(k * block, min((k + 1) * block, width))
            size = n * (dims.stop - dims.start)
            parts.append((dims, _exact(values[at : at + size].reshape(n, -1), scale), code[k]))
            at += size
        yield ids, parts


def nearest(parts: list[tuple[slice, np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (the smaller number of two) and its squared distance.

    A distinct subvector's distance to every centroid is taken once; a vector sums what its codes name.
    """
    total = 0
    for dims, entries, code in parts:
        if entries.dtype != centroids.dtype:
            entries = entries.astype(object)
        apart = entries[:, None, :] - centroids[None, :, dims]
        total = total + (apart * apart).sum(axis=-1)[code]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best]


def _array(centroids: Sequence[Sequence[int]]) -> np.ndarray:
    small = all(abs(x) < SAFE for c in centroids for x in c)
    return np.array(centroids, np.int64 if small else object)


def move(pages: DataFrame, centroids: list[list[int]], block: int, scale: int) -> list[list[int]]:
    """The centroids after one round: floor of the mean of what is nearest to each; one without vectors stays.

    Sums are exact: a task adds up entries by how often a code occurs and hands on one number per centroid, dimension
    and digit, of which Spark takes the sums; the driver gets these alone.
    """
    k, width = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _array(centroids)
        sums: dict[tuple[int, int], int] = defaultdict(int)
        for batch in batches:
            for ids, parts in _pages(batch, width, block, scale):
                best, _ = nearest(parts, now)
                for c, n in enumerate(np.bincount(best, minlength=k).tolist()):
                    sums[c, -1] += n
                for dims, entries, code in parts:
                    often = np.bincount(best * len(entries) + code, minlength=k * len(entries)).reshape(k, -1)
                    for c, row in enumerate((often.astype(entries.dtype) @ entries).tolist()):
                        for d, x in enumerate(row, dims.start):
                            sums[c, d] += x
        rows = []
        for (c, d), x in sums.items():
            digit = 0
            while x:  # all digits but the last are positive, the last keeps the sign
                last = -(1 << DIGIT) <= x < 1 << DIGIT
                rows.append((c, d, digit, x if last else x & ((1 << DIGIT) - 1)))
                x = 0 if last else x >> DIGIT
                digit += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "dim", "digit", "n"])

    cells = pages.mapInArrow(run, "cluster int, dim int, digit int, n long").groupBy("cluster", "dim", "digit").agg(F.sum("n").alias("n"))
    sums: dict[tuple[int, int], int] = defaultdict(int)
    for r in cells.collect():
        sums[r["cluster"], r["dim"]] += r["n"] << (DIGIT * r["digit"])
    return [[sums[c, d] // sums[c, -1] for d in range(width)] if sums[c, -1] else old for c, old in enumerate(centroids)]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, block: int = BLOCK, chunk: int = CHUNK) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids.

    ``vectors`` has (vec_id, embedding); which of them take part, ``grid`` says. Centroids start as the vectors whose ids
    have the least SHA-256; equal ids are told apart by their vectors, and a null id starts none. With fewer vectors
    there are fewer centroids, and without any the result is empty. Each row of a repeated id counts. A distance beyond a long is
    returned as the long's end, but compared by its value. Extra columns are not read.
    """
    spark = vectors.sparkSession
    able = grid(vectors, width, scale)
    hashed = F.sha2(F.concat(F.lit(SEED), F.col("vec_id").cast("string")), 256)
    first = able.where("vec_id is not null").select(hashed.alias("hash"), "y").orderBy("hash", "y").limit(clusters).collect()
    centroids = [_exact(np.array(r["y"]), scale).tolist() for r in first]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    pages = shared_table(encode(able, block, chunk), "vector_pages")
    for _ in range(rounds):
        centroids = move(pages, centroids, block, scale)
    last = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _array(last)
        for batch in batches:
            for ids, parts in _pages(batch, width, block, scale):
                best, apart = nearest(parts, now)
                held = np.minimum(apart, LONG).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best.astype(np.int32)), pa.array(held)], names=["vec_id", "cluster", "distance"])

    return pages.mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster and distance, with the sums over its cluster and over all, and its centroid's digest."""
    assigned, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    assigned = shared_table(assigned, "vector_clusters")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(total.alias("total")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    held = lambda n: F.lit(min(n, LONG)).cast("long")
    # as many literals as centroids
    own = [F.struct(held(inertia.get(c, 0)).alias("inertia"), F.lit(digest(x)).alias("sha256")) for c, x in enumerate(centroids or [[]])]
    of = F.get(F.array(*own), "cluster")
    return assigned.select("vec_id", "cluster", "distance", of["inertia"].alias("cluster_inertia"), held(sum(inertia.values())).alias("inertia"), of["sha256"].alias("centroid_sha256"))


def _oracle(rounds: int = ROUNDS) -> str:
    apart = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    assign = f"select v.rid, arg_min(c.cluster, ({apart}, c.cluster)) cluster, min({apart}) distance from v, %s c group by v.rid"
    parts = [
        f"""v as materialized (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as hugeint)) q from embeddings
            where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {WIDTH})""",
        f"""c0 as materialized (select cast(row_number() over (order by h, q) - 1 as integer) cluster, q from
            (select sha256('{SEED}' || vec_id) h, q from v where vec_id is not null order by h, q limit {CLUSTERS}))""",
    ]
    for r in range(rounds):
        parts.append(f"a{r} as materialized ({assign % f'c{r}'})")
        parts.append(
            f"""m{r} as materialized (select cluster, list(cast((s - ((s % n) + n) % n) / n as hugeint) order by i) q from
            (select a.cluster, i, sum(v.q[i]) s, count(*) n from a{r} a join v using (rid), range(1, 65) t(i) group by all) group by cluster)"""
        )
        parts.append(f"c{r + 1} as materialized (select c.cluster, coalesce(m.q, c.q) q from c{r} c left join m{r} m using (cluster))")
    parts.append(f"a as materialized ({assign % f'c{rounds}'})")
    return f"""with {", ".join(parts)}
    select v.vec_id, a.cluster, cast(a.distance as bigint) distance, cast(sum(a.distance) over (partition by a.cluster) as bigint) cluster_inertia,
           cast(sum(a.distance) over () as bigint) inertia, sha256(array_to_string(c.q, ',')) centroid_sha256
    from a join v using (rid) join c{rounds} c using (cluster)"""


ORACLE_SQL = _oracle()
