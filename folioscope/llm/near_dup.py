"""Join of documents whose word shingles have a Jaccard similarity of 0.8 or more, by a MinHash LSH forest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import mix64, shared_table, slices, span_hashes, utf8, whole_text, word_spans
from folioscope.llm.graph import components

SHINGLE_WORDS = 5
THRESHOLD = (4, 5)  # similarity as a fraction
TREES, TREE_DEPTH = 24, 6
#: Chance that a pair at the threshold itself shares a prefix in some tree.
TARGET_RECALL = 0.99999
#: Pairs of which fewer signature values agree are not followed (of TREES * TREE_DEPTH; 7 deviations below 0.8).
LEAST_AGREEMENT = 0.58
#: Members of a trie node that are compared in one go; a fuller node is dealt into parts.
PART_MEMBERS = 4096
#: Sets of a large cluster from which its centre is made. The centre saves comparisons; results do not depend on it.
CENTRE_SETS = 64
#: Documents and shingles that one block of the exact comparison holds on average, and shingles multiplied at a time.
BLOCK_DOCUMENTS, BLOCK_SHINGLES, BLOCK_COLUMNS = 512, 1_000_000, 4096
SLICE_BYTES = 2 << 20

_VALUES = TREES * TREE_DEPTH
_MULTIPLIERS = mix64(np.arange(1, _VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def prefix_depths(threshold: float, target: float = TARGET_RECALL, trees: int = TREES, deepest: int = TREE_DEPTH) -> list[int]:
    """Prefix lengths to try, longest first: down to the first k at which 1 - (1 - threshold**k)**trees reaches the target."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return list(range(deepest, depth - 1, -1))


def shingle_sets(texts: pa.Array, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles; a shorter text is one shingle."""
    data, offsets = utf8(texts)
    starts, ends = word_spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    words = span_hashes(data, starts, ends)
    wide = max(len(words) - width + 1, 0)
    rolled = np.zeros(wide, np.uint64)
    for k in range(width):
        rolled = mix64(rolled + words[k : k + wide])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for w in words[a:b]:
                short = mix64(short + w)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each), TREE_DEPTH of them for each tree."""
    least = np.full(_VALUES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 8192):
        part = shingles[at : at + 8192]
        for k in range(0, _VALUES, 16):
            least[k : k + 16] = np.minimum(least[k : k + 16], (_MULTIPLIERS[k : k + 16, None] * part).min(1))
    return (least >> np.uint64(32)).astype("<u4")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        keys, counts, signatures = [], [], []
        for s in shingle_sets(batch.column("text")):
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            counts.append(len(s))
            signatures.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(signatures, pa.binary())],
            names=["doc_id", "text_key", "set_key", "n_shingles", "signature"],
        )


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set_key (digest of the shingle set), n_shingles and the MinHash signature of every row."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(whole_text().cast("binary")).alias("text_key"), whole_text().alias("text"))
    return keyed.mapInArrow(_sketches, "doc_id long, text_key string, set_key binary, n_shingles long, signature binary")


def _links(keys: list[bytes], labels: np.ndarray, short: np.ndarray) -> tuple[list[tuple[bytes, bytes]], list[bytes]]:
    """Links between members of one trie node whose signatures agree often enough, and one member of each group that results.

    Members of equal label are connected already. Grown breadth first; what a group takes in, with all
    of its label, is never compared again, so a node of close copies costs one pass over it.
    """
    least = int(LEAST_AGREEMENT * _VALUES)
    order = np.argsort(labels, kind="stable")
    bounds = np.searchsorted(labels[order], labels[order], "left"), np.searchsorted(labels[order], labels[order], "right")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    free, out, roots = np.ones(len(keys), bool), [], []
    for root in range(len(keys)):
        if not free[root]:
            continue
        roots.append(keys[root])
        queue = order[bounds[0][place[root]] : bounds[1][place[root]]].tolist()
        free[queue] = False
        while queue:
            at = queue.pop()
            others = np.flatnonzero(free)
            if not len(others):
                break
            for k in others[(short[others] == short[at]).sum(1) >= least].tolist():
                if free[k]:
                    out.append((keys[at], keys[k]))
                    taken = order[bounds[0][place[k]] : bounds[1][place[k]]]
                    free[taken] = False
                    queue += taken.tolist()
    return out, roots


_NODE_LINKS = "a binary, b binary, bucket long"


def _node_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within each part of a trie node; rows come sorted by node and part.

    Of a node that was dealt into parts, each part also names its groups' first members, as (member, null, node).
    """

    def flush() -> list[tuple]:
        if not keys:
            return []
        links, roots = _links(keys, np.array(labels, np.int64), np.frombuffer(b"".join(shorts), np.uint8).reshape(len(keys), _VALUES))
        return [(a, b, None) for a, b in links] + ([(r, None, node[0]) for r in roots] if parts > 1 else [])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "bucket"])

    node, parts, keys, labels, shorts, out = None, 1, [], [], [], []
    for batch in batches:
        for b, part, n, k, x, s in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "parts", "set_key", "label", "short"))):
            if (b, part) != node:
                out += flush()
                node, parts, keys, labels, shorts = (b, part), n, [], [], []
            keys.append(k)
            labels.append(x)
            shorts.append(s)
        if out:
            yield table(out)
            out = []
    out = flush()
    if out:
        yield table(out)


def _entries(depth: int):
    """One row for each set and tree: the trie node of ``depth`` values (hash of tree and prefix) and the values below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(n, TREES, TREE_DEPTH)
            node = np.tile(np.arange(TREES, dtype=np.uint64), (n, 1))
            for k in range(depth):
                node = mix64(node + values[:, :, k].astype(np.uint64))
            tail = np.ascontiguousarray(values[:, :, depth:]).reshape(n * TREES, -1)
            keys = batch.column("set_key").take(pa.array(np.repeat(np.arange(n), TREES)))
            tails = pa.array([t.tobytes() for t in tail], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(node.ravel().view(np.int64)), tails, keys], names=["node", "tail", "set_key"])

    return run


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The low byte of each signature value: enough to estimate a similarity."""
    for batch in batches:
        short = [np.frombuffer(s, "<u4").astype(np.uint8).tobytes() for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("set_key"), pa.array(short, pa.binary())], names=["set_key", "short"])


def forest(sets: DataFrame, depth: int) -> DataFrame:
    """(node, tail, set_key): the tries cut at ``depth``, without the nodes that hold one set only.

    A set appears once for each tree; below its node hang the remaining values of its signature in that tree.
    """
    entries = sets.select("set_key", "signature").mapInArrow(_entries(depth), "node long, tail binary, set_key binary")
    shared = shared_table(entries.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "nodes")
    # a merge join at every size, as the nodes grow with the table
    return shared_table(entries.join(shared.hint("merge"), "node"), "forest")


def node_links(tries: DataFrame, shorts: DataFrame, labels: DataFrame | None, below: int) -> DataFrame:
    """New links (a, b) from the trie nodes ``below`` values under the forest's cut that do not lie within one label yet.

    Nodes are judged by a count and the least and greatest label (combined before the shuffle); a node
    whose members are connected already, or that has one member, costs nothing more. A crowded node is
    dealt into parts of some PART_MEMBERS by hash; the parts' groups are then joined to one another
    without a look at their signatures, which may widen a cluster but loses nothing.
    """
    held = tries if labels is None else tries.join(labels, "set_key", "left")
    label = F.col("set_key") if labels is None else F.coalesce("label", "set_key")
    entries = held.select(F.xxhash64("node", F.substring("tail", 1, 4 * below)).alias("bucket"), "set_key", F.xxhash64(label).alias("label"))
    nodes = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    nodes = nodes.select("bucket", F.ceil(F.col("n") / PART_MEMBERS).cast("int").alias("parts"))
    together = entries.join(nodes, "bucket").withColumn("part", F.expr("cast(pmod(xxhash64(set_key, bucket), parts) as int)"))
    found = together.join(shorts, "set_key").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "set_key").mapInArrow(_node_links, _NODE_LINKS)
    found = shared_table(found, "found")
    roots = found.where("b is null")
    stars = roots.select("a", "bucket").join(roots.groupBy("bucket").agg(F.min("a").alias("b")), "bucket").select("a", "b")
    return found.where("b is not null").select("a", "b").union(stars).where("a <> b").distinct()


def forest_clusters(sets: DataFrame, threshold: float = THRESHOLD[0] / THRESHOLD[1]) -> DataFrame | None:
    """(set_key, label): clusters of the sets that the MinHash forest connects; None if it connects none.

    Prefixes are matched at full depth first. Then they are shortened, level by level, down to the depth
    of the target recall, but only in trie nodes that still hold sets of different clusters.
    """
    depths = prefix_depths(threshold)
    tries = forest(sets, depths[-1])
    members = tries.select("set_key").distinct()
    shorts = shared_table(sets.select("set_key", "signature").join(members, "set_key").mapInArrow(_short, "set_key binary, short binary"), "shorts")
    labels = None
    for depth in depths:
        links = shared_table(node_links(tries, shorts, labels, depth - depths[-1]), "links")
        if links.isEmpty():
            continue
        if labels is not None:
            links = links.union(labels.where("set_key <> label"))
        labels = components(links).select(F.col("vertex").alias("set_key"), F.col("component").alias("label"))
    return labels


def _member_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        sets = [s.tobytes() for s in shingle_sets(batch.column("text"))]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sets, pa.binary())], names=[*names, "shingles"])


def shared_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of distinct shingle hashes, by products of 0/1 matrices."""
    pooled = np.concatenate([*left, *right])
    _, column = np.unique(pooled, return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    there = [np.zeros(column.max(initial=-1) + 1, bool) for _ in range(2)]
    is_right = owner >= len(left)
    there[0][column[~is_right]], there[1][column[is_right]] = True, True
    both = there[0] & there[1]
    number = np.cumsum(both) - 1
    used = both[column]
    owner, column, is_right = owner[used], number[column[used]], is_right[used]
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column, is_right = owner[order], column[order], is_right[order]
    for at in range(0, int(both.sum()), BLOCK_COLUMNS):
        a, b = np.searchsorted(column, [at, at + BLOCK_COLUMNS])
        wide = min(BLOCK_COLUMNS, int(both.sum()) - at)
        x, y = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
        o, c, r = owner[a:b], column[a:b] - at, is_right[a:b]
        x[o[~r], c[~r]] = 1
        y[o[r] - len(left), c[r]] = 1
        total += x @ y.T
    return np.rint(total).astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs of two lists of sets reach the threshold."""
    inter = shared_shingles(left, right)
    top, bottom = THRESHOLD
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    return bottom * inter >= top * (sizes[0][:, None] + sizes[1][None, :] - inter)


def _groups(pairs: np.ndarray, names: list[bytes]) -> list[bytes]:
    """The least name in the connected group of each vertex, given the matrix of pairs."""
    root = np.full(len(names), -1)
    for seed in sorted(range(len(names)), key=names.__getitem__):
        if root[seed] >= 0:
            continue
        root[seed], queue = seed, [seed]
        while queue:
            near = np.flatnonzero(pairs[queue.pop()] & (root < 0))
            root[near] = seed
            queue += near.tolist()
    return [names[r] for r in root.tolist()]


def _sets(table: pa.Table) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    return table.column("set_key").to_pylist(), [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()], np.array(table.column("copies").to_pylist(), np.int64)


_COUNTS = "set_key binary, label binary, n_texts long, n_docs long"


def _within(table: pa.Table) -> pa.Table:
    """Exact links within one block: each set's counts, and the least key of the group it belongs to there."""
    keys, sets, copies = _sets(table)
    pairs = linked(sets, sets)
    np.fill_diagonal(pairs, False)
    labels = _groups(pairs, keys)
    return pa.table({"set_key": pa.array(keys, pa.binary()), "label": pa.array(labels, pa.binary()), "n_texts": pa.array(pairs.sum(1).astype(np.int64)), "n_docs": pa.array((pairs @ copies).astype(np.int64))})


def _between(table: pa.Table) -> pa.Table:
    """Exact links between two blocks: counts for each set that has some, and links (set_key, label) of the blocks' groups.

    At most one link is returned for each group that another takes in, so blocks whose groups are one already return few.
    """
    keys, sets, copies = _sets(table)
    labels, first = table.column("label").to_pylist(), np.array(table.column("first").to_pylist())
    rows, cols = np.flatnonzero(first), np.flatnonzero(~first)
    if not len(rows) or not len(cols):
        return pa.table({"set_key": pa.array([], pa.binary()), "label": pa.array([], pa.binary()), "n_texts": pa.array([], pa.int64()), "n_docs": pa.array([], pa.int64())})
    pairs = linked([sets[k] for k in rows], [sets[k] for k in cols])
    texts, docs = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    texts[rows], texts[cols] = pairs.sum(1), pairs.sum(0)
    docs[rows], docs[cols] = pairs @ copies[cols], pairs.T @ copies[rows]
    names = sorted(set(labels))
    number = {x: k for k, x in enumerate(names)}
    group = np.array([number[x] for x in labels])
    touch = np.zeros((len(names), len(names)), bool)
    i, j = np.nonzero(pairs)
    touch[group[rows[i]], group[cols[j]]] = True
    touch |= touch.T
    joined = [(x, y) for x, y in zip(names, _groups(touch, names)) if x != y]
    counted = np.flatnonzero(texts).tolist()
    return pa.table(
        {
            "set_key": pa.array([keys[k] for k in counted] + [x for x, _ in joined], pa.binary()),
            "label": pa.array([None] * len(counted) + [y for _, y in joined], pa.binary()),
            "n_texts": pa.array(texts[counted].tolist() + [0] * len(joined), pa.int64()),
            "n_docs": pa.array(docs[counted].tolist() + [0] * len(joined), pa.int64()),
        }
    )


def _centre(table: pa.Table) -> pa.Table:
    """The shingles that at least half of a cluster's sampled sets hold."""
    every, n = np.unique(np.concatenate(_sets(table)[1]), return_counts=True)
    return pa.table({"component": table.column("component").slice(0, 1), "centre": pa.array([every[2 * n >= table.num_rows].tobytes()], pa.binary())})


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``core``: whether a set is within half the allowed distance of its cluster's centre."""
    top, bottom = THRESHOLD
    for batch in batches:
        flags = []
        for s, c in zip(batch.column("shingles").to_pylist(), batch.column("centre").to_pylist()):
            own, centre = np.frombuffer(s, np.uint64), np.frombuffer(c, np.uint64)
            both = len(np.intersect1d(own, centre, assume_unique=True))
            flags.append(2 * bottom * both >= (bottom + top) * (len(own) + len(centre) - both))
        names = [n for n in batch.schema.names if n != "centre"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(flags, pa.bool_())], names=[*names, "core"])


def _dealt(members: DataFrame, *zone: str) -> DataFrame:
    """``members`` with ``block`` and ``blocks``: each zone dealt by hash into blocks of bounded mean number and size."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_DOCUMENTS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy(*zone).agg(blocks.alias("blocks"))
    return members.join(sizes, list(zone)).withColumn("block", F.expr("cast(pmod(xxhash64(set_key), blocks) as int)"))


def member_sets(docs: DataFrame, sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """(set_key, component, copies, n_shingles, block, blocks, shingles) of all sets in clusters, from one text each."""
    within = clusters.withColumnRenamed("label", "component").join(sets.select("set_key", "rep_id", "rep_text", "copies", "n_shingles"), "set_key")
    members = shared_table(_dealt(within, "component"), "within")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(whole_text().cast("binary")).alias("text_key"), whole_text().alias("text"))
    # a merge join at every size, as the texts of a large table will not meet a broadcast side
    found = members.hint("merge").join(texts, (members["rep_text"] == texts["text_key"]) & members["rep_id"].eqNullSafe(texts["doc_id"]))
    found = found.select("set_key", "component", "copies", "n_shingles", "block", "blocks", "text").dropDuplicates(["set_key"])
    return shared_table(found.mapInArrow(_member_sets, "set_key binary, component binary, copies long, n_shingles long, block int, blocks int, shingles binary"), "members")


def exact_links(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Partial counts (set_key, n_texts, n_docs) and links (a, b) that connect linked sets, from exact comparison.

    A cluster of one block is compared in one task. In a larger one, sets within half the allowed
    distance of the cluster's centre (the shingles that most of CENTRE_SETS sets hold) form its core:
    Jaccard distance is a metric, so all pairs of core sets are linked and are counted without being
    compared. The other sets are compared block by block among themselves, which also
    names each block's groups, and then with the other blocks and those of the core. Between two blocks
    only links of different groups are returned.
    """
    core_name = lambda c: F.concat(F.lit(b"core"), c)
    one = members.where("blocks = 1").select("component", "set_key", "copies", "shingles", "block")
    large = members.where("blocks > 1")
    if large.isEmpty():
        done = shared_table(one.groupBy("component", "block").applyInArrow(_within, _COUNTS), "within")
        return done.select("set_key", "n_texts", "n_docs"), done.where("set_key <> label").select(F.col("set_key").alias("a"), F.col("label").alias("b"))
    first = large.withColumn("at", F.row_number().over(Window.partitionBy("component").orderBy("set_key"))).where(F.col("at") <= CENTRE_SETS)
    centres = first.select("component", "set_key", "copies", "shingles").groupBy("component").applyInArrow(_centre, "component binary, centre binary")
    # a centre goes to each block of its cluster, so that the cluster does not meet at one key
    per_block = large.select("component", "block").distinct().join(centres, "component")
    schema = "component binary, set_key binary, copies long, n_shingles long, shingles binary, core boolean"
    cored = shared_table(large.drop("blocks").join(per_block, ["component", "block"]).select("component", "set_key", "copies", "n_shingles", "shingles", "centre").mapInArrow(_cores, schema), "cores")
    zoned = _dealt(cored, "component", "core")
    outer, inner = zoned.where("not core"), zoned.where("core")
    within = shared_table(one.unionByName(outer.select("component", "set_key", "copies", "shingles", "block")).groupBy("component", "block").applyInArrow(_within, _COUNTS), "within")
    counts, links = within.select("set_key", "n_texts", "n_docs"), within.where("set_key <> label").select(F.col("set_key").alias("a"), F.col("label").alias("b"))
    # all pairs of the core
    sums = cored.where("core").groupBy("component").agg(F.count("*").alias("sets"), F.sum("copies").alias("docs"))
    counts = counts.union(cored.where("core").join(sums, "component").select("set_key", (F.col("sets") - 1).alias("n_texts"), (F.col("docs") - F.col("copies")).alias("n_docs")))
    links = links.union(cored.where("core").select(F.col("set_key").alias("a"), core_name(F.col("component")).alias("b")))
    # blocks of other sets meet each other and the core's
    zones = zoned.groupBy("component").agg(F.coalesce(F.max(F.when(~F.col("core"), F.col("blocks"))), F.lit(0)).alias("outer_blocks"), F.coalesce(F.max(F.when(F.col("core"), F.col("blocks"))), F.lit(0)).alias("core_blocks"))
    pair = lambda i, j, first: F.struct(i.alias("i"), j.alias("j"), first.alias("first"))
    yes, no = F.lit(True), F.lit(False)
    own, n_outer, n_core = F.col("block"), F.col("outer_blocks"), F.col("core_blocks")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    mates = F.filter(upto(n_outer), lambda k: k != own)
    of_outer = F.concat(F.transform(mates, lambda k: pair(F.least(own, k), F.greatest(own, k), own < k)), F.transform(upto(n_core), lambda k: pair(own, -1 - k, yes)))
    of_core = F.transform(upto(n_outer), lambda k: pair(k, -1 - own, no))
    labels = within.select("set_key", "label")
    columns = ("component", "set_key", "copies", "shingles", "label")
    left = outer.join(labels, "set_key").join(zones, "component").select(*columns, F.inline(of_outer))
    right = inner.withColumn("label", core_name(F.col("component"))).join(zones, "component").select(*columns, F.inline(of_core))
    across = shared_table(left.unionByName(right).groupBy("component", "i", "j").applyInArrow(_between, _COUNTS), "between")
    counts = counts.union(across.where("label is null").select("set_key", "n_texts", "n_docs"))
    return counts, links.union(across.where("label is not null").select("set_key", "label"))


def similarity_join(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, n_links, n_text_links, copy_id, n_copies.

    Two documents are linked if their sets of 5-word shingles have a Jaccard similarity of 0.8 or
    more; ``n_links`` counts a document's links to other documents, copies included, ``n_text_links``
    those to other shingle sets. ``class_id`` is the least doc_id among the documents that links
    connect, ``copy_id`` the least with the same set, ``n_copies`` their number.

    Documents with the same set are one vertex throughout. Texts of one to four words are a single
    shingle; those without a word (null, empty) link to nothing and form a class each. Rows without
    a doc_id take part; their class may be null. An empty table gives no rows.
    """
    rows = shared_table(sketch(docs), "sketches")
    worded = rows.where("n_shingles > 0")
    sets = shared_table(
        worded.groupBy("set_key").agg(
            F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.min("signature").alias("signature"), F.min("n_shingles").alias("n_shingles")
        ).select("set_key", "copy_id", "copies", "signature", "n_shingles", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_text")),
        "sets",
    )
    clusters = forest_clusters(sets)
    if clusters is None:
        classes, counts = sets.select(F.col("set_key").alias("vertex"), F.col("set_key").alias("component")), sets.select("set_key", F.lit(0).alias("n_texts"), F.lit(0).alias("n_docs"))
    else:
        counts, links = exact_links(member_sets(docs, sets, clusters))
        classes = components(links)
    counts = counts.groupBy("set_key").agg(F.sum("n_texts").alias("n_text_links"), F.sum("n_docs").alias("other_docs"))
    placed = sets.select("set_key", "copy_id", "copies").join(classes.withColumnRenamed("vertex", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    least = placed.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    by_set = placed.join(least, "component").join(counts, "set_key", "left").select(
        "set_key", "class_id", "copy_id", F.col("copies").alias("n_copies"),
        F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
        (F.coalesce("other_docs", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )
    alone: dict[str, Column] = {"class_id": F.col("doc_id"), "copy_id": F.col("doc_id"), "n_copies": F.lit(1), "n_text_links": F.lit(0), "n_links": F.lit(0)}
    joined = rows.select("doc_id", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")).join(by_set, "set_key", "left")
    return joined.select("doc_id", *[F.when(F.col("set_key").isNull(), v).otherwise(F.col(c)).cast("long").alias(c) for c, v in alone.items()])


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and link counts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = similarity_join(docs)
    return out.select("doc_id", "class_id", "n_links", "n_text_links", "copy_id", "n_copies")


ORACLE_SQL = """
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                         when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from d),
n as (select doc_id, count(*) n from s group by 1),
h as (select doc_id, md5(string_agg(g, chr(10) order by g)) h from s group by 1),
c as (select doc_id, h, min(doc_id) over (partition by h) copy_id, count(*) over (partition by h) n_copies from h),
p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 5 * k >= 4 * (x.n + y.n - k)),
reach as (select a, b from l union select r.a, l.b from reach r join l on r.b = l.a),
k as (select a doc_id, min(b) low from reach group by 1),
t as (select l.a doc_id, count(*) n_links, count(distinct y.h) - max((y.h = x.h)::int) n_text_links from l join c x on x.doc_id = l.a join c y on y.doc_id = l.b group by 1)
select d.doc_id, least(d.doc_id, coalesce(low, d.doc_id)) class_id, coalesce(n_links, 0) n_links, cast(coalesce(n_text_links, 0) as bigint) n_text_links,
       coalesce(copy_id, d.doc_id) copy_id, coalesce(n_copies, 1) n_copies
from d left join c using (doc_id) left join k using (doc_id) left join t using (doc_id)
"""
