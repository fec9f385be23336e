"""Exact removal of long repeated byte strings, by a sparse suffix array over the corpus.

Sorting a suffix at every byte would move each text hundreds of times. Instead each window of
``length`` bytes names one of its own positions, its anchor: the place of the least hash of
``length // 2`` bytes, leftmost on ties. Equal windows name the same anchor, so it is enough to sort the
suffixes (and, to their left, the reversed prefixes) at anchors whose key bytes occur twice. Two
windows are equal exactly if their anchors stand at the same offset d, agree for d bytes to the left
and for length - d to the right, which the two sorted orders answer for all d. The hash only picks
positions; what is removed is decided by comparing bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import mix64, powers, shared_table, slices, utf8, whole_text
from folioscope.llm.common import _BASE_INVERSE as BASE_INVERSE

LENGTH = 400
SLICE_BYTES = 1 << 20
#: Segments sorted at a time. A key with more of them is not sorted in one place but counted window by window.
SORT_SEGMENTS = 16_384


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (row, first window, last window, anchor, key hash), in order."""
    n, key = len(data), length // 2
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(np.uint64)
    up, down = powers(n), powers(n, BASE_INVERSE)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    hashes = mix64((sums[key:] - sums[:-key]) * down[: n - key + 1])
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    span, width = 1, length - key + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - length + 1, 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[row]
    at = at[start]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])])) if len(row) else none
    last = np.concatenate([first[1:] - 1, [len(row) - 1]]) if len(first) else none
    return row[first], start[first], start[last], at[first], hashes[at[first]]


def _anchor_keys(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            data, offsets = utf8(batch.column("text"))
            row, _, _, _, key = anchors(data, offsets, length)
            pairs, n = np.unique(np.stack([row.astype(np.uint64), key], 1), axis=0, return_counts=True) if len(row) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
            tids = batch.column("tid").take(pa.array(pairs[:, 0].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([tids, pa.array(pairs[:, 1].view(np.int64)), pa.array(n.astype(np.int64))], names=["tid", "key", "n"])

    return run


SEGMENT = "seg binary, key long, lead binary, content binary, left int, least int, most int, tids array<binary>, starts array<int>"


def _segments(length: int):
    """Cut out, once per slice and content, the bytes that the windows of a surviving anchor cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            data, offsets = utf8(batch.column("text"))
            row, first, last, at, key = anchors(data, offsets, length)
            keys = batch.column("keys")
            lengths = np.array([len(k) for k in keys], np.int64)
            wanted = np.stack([np.repeat(np.arange(len(lengths)), lengths).astype(np.uint64), np.array(keys.flatten(), np.int64).view(np.uint64)], 1)
            there = np.isin(
                mix64(mix64(row.astype(np.uint64)) + key), mix64(mix64(wanted[:, 0]) + wanted[:, 1])
            ) if len(row) else np.zeros(0, bool)
            raw, tids = data.tobytes(), batch.column("tid").to_pylist()
            found: dict[bytes, list] = {}
            for r, a, b, x, k in zip(*(v[there].tolist() for v in (row, first, last, at)), key[there].view(np.int64).tolist()):
                content = raw[a : b + length]
                seg = hashlib.blake2b(content, digest_size=16, salt=(x - a).to_bytes(8, "big")).digest()
                entry = found.get(seg)
                if entry is None:
                    entry = found[seg] = [k, raw[x : x + 16], content, x - a, x - b, x - a, [], []]
                entry[6].append(tids[r])
                entry[7].append(a - int(offsets[r]))
            out = list(found.items())
            types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            columns = [pa.array([s for s, _ in out], pa.binary())] + [pa.array([e[i] for _, e in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=["seg", "key", "lead", "content", "left", "least", "most", "tids", "starts"])

    return run


def multikey_sort(tokens: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of rows by group, then by their tokens from left to right.

    Multikey quicksort with 8-byte tokens, all partitions of one depth at a time: rows still tied are
    sorted by their next token only, and a row that stands alone is never looked at again.
    """
    order = np.argsort(group, kind="stable")
    part = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]]))
    for depth in range(tokens.shape[1]):
        tied = np.concatenate([[False], part[1:] == part[:-1]])
        tied[:-1] |= tied[1:].copy()
        place = np.flatnonzero(tied)
        if not len(place):
            break
        rows = order[place]
        token = np.unique(tokens[rows, depth], return_inverse=True)[1]
        key = part[place] * (token.max() + 1) + token
        by = np.argsort(key, kind="quicksort")
        order[place] = rows[by]
        key = key[by]
        fresh = np.zeros(len(order), np.int64)
        fresh[place[1:]] = (key[1:] != key[:-1]) & (part[place][1:] == part[place][:-1])
        part = part + np.cumsum(fresh)
    return order


def _common(bytes_: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each sorted row with the one before; -1 at a group's start."""
    out = np.full(len(order), -1, np.int64)
    width = bytes_.shape[1]
    for at in range(1, len(order), 4096):
        a, b = order[at - 1 : at + 4095], order[at : at + 4096]
        a = a[: len(b)]
        differ = bytes_[a] != bytes_[b]
        same = np.where(differ.any(1), differ.argmax(1), width)
        out[at : at + len(b)] = np.where(group[a] == group[b], same, -1)
    return out


def repeated_windows(contents: list[bytes], left: np.ndarray, least: np.ndarray, most: np.ndarray, seen: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """[segment, most - d] is true if the window whose anchor stands d bytes in occurs at another place too."""
    m, reach = len(contents), int(most.max()) + 1
    right_bytes, left_bytes = np.zeros((m, -(-length // 8) * 8), np.uint8), np.zeros((m, -(-max(reach, 1) // 8) * 8), np.uint8)
    for i, (c, x) in enumerate(zip(contents, left.tolist())):
        b = np.frombuffer(c, np.uint8) + np.uint8(1)  # UTF-8 has no byte 255; 0 is left for "beyond the end"
        r = b[x : x + length]
        right_bytes[i, : len(r)] = r
        left_bytes[i, :x] = b[:x][::-1]
    rank = []
    for table in (right_bytes, left_bytes):
        order = multikey_sort(table.view(">u8").astype(np.uint64), group)
        rank.append((order, _common(table, group, order)))
    out = np.zeros((m, reach), bool)
    for d in range(reach):
        rows = np.flatnonzero((least <= d) & (d <= most))
        if not len(rows):
            continue
        name = []
        for (order, common), depth in zip(rank, (length - d, d)):
            label = np.zeros(m, np.int64)
            label[order] = np.cumsum(common < depth)
            name.append(label[rows])
        _, inverse = np.unique(name[0] * (m + 1) + name[1], return_inverse=True)
        times = np.bincount(inverse, weights=seen[rows])
        hit = rows[times[inverse] >= 2]
        out[hit, most[hit] - d] = True
    return out


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist()


def _sorted_buckets(length: int):
    """Compare the segments of a bucket, a few thousand at a time; a key's segments stay together."""

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        keys = [r[1] for r in rows]
        group = np.cumsum([0] + [a != b for a, b in zip(keys, keys[1:])])
        numbers = [np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5, 6)]
        hits = repeated_windows([r[2] for r in rows], *numbers, group, length)
        some = np.flatnonzero(hits.any(1)).tolist()
        runs = [_runs(hits[i]) for i in some]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in some], pa.binary()), pa.array([r[0] for r in runs], pa.list_(pa.int32())), pa.array([r[1] for r in runs], pa.list_(pa.int32()))],
            names=["seg", "from", "to"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += list(zip(*(batch.column(c).to_pylist() for c in ("seg", "key", "content", "left", "least", "most", "seen"))))
            if len(held) >= SORT_SEGMENTS:
                cut = len(held)
                while cut and held[cut - 1][1] == held[-1][1]:
                    cut -= 1
                if cut:
                    yield judge(held[:cut])
                    held = held[cut:]
        if held:
            yield judge(held)

    return run


def _windows(length: int):
    """One row per window of each segment: its digest and its place in the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                segs, digests, places, seen = [], [], [], []
                part = batch.slice(at, 512)
                for seg, content, least, most, n in zip(*(part.column(c).to_pylist() for c in ("seg", "content", "least", "most", "seen"))):
                    for k in range(most - least + 1):
                        segs.append(seg)
                        digests.append(hashlib.blake2b(content[k : k + length], digest_size=16).digest())
                        places.append(k)
                        seen.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(segs, pa.binary()), pa.array(digests, pa.binary()), pa.array(places, pa.int32()), pa.array(seen, pa.int64())], names=["seg", "window", "place", "seen"])

    return run


def _count_windows(distinct: DataFrame, length: int) -> DataFrame:
    """What the sorted buckets give, for keys with too many segments for one bucket: windows are counted by digest.

    Counts are summed per task before they are shuffled, and no window's rows have to meet in one task.
    """
    rows = distinct.select("seg", "content", "least", "most", "seen").mapInArrow(_windows(length), "seg binary, window binary, place int, seen long")
    often = rows.groupBy("window").agg(F.sum("seen").alias("n")).where("n > 1").select("window")
    hits = rows.join(often, "window").groupBy("seg").agg(F.collect_set("place").alias("from"))
    return hits.select("seg", "from", F.col("from").alias("to"))


def _cut(length: int):
    """Remove the covered bytes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            removed, spans, digests, kept = [], [], [], []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends"))):
                data = np.frombuffer((text or "").encode(), np.uint8)
                cover = np.zeros(len(data) + 1, np.int64)
                np.add.at(cover, np.array(starts, np.int64), 1)
                np.subtract.at(cover, np.array(ends, np.int64) + length, 1)
                gone = np.cumsum(cover[:-1]) > 0
                rest = data[~gone].tobytes()
                removed.append(int(gone.sum()))
                spans.append(len(_runs(gone)[0]))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("tid"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                names=["tid", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def _bucketed(texts: DataFrame, key: str, made: list[str]) -> DataFrame:
    """Write a table bucketed by ``key`` in the warehouse, so that later joins on it need not move the texts; its name goes to ``made``."""
    spark = texts.sparkSession
    name = f"folioscope_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.bucketBy(buckets, key).sortBy(key).saveAsTable(name, format="parquet")
    made.append(name)
    return spark.table(name)


def repeated_spans(docs: DataFrame, length: int, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """The bucketed table of distinct long texts (tid, text, copies), and each text's repeated windows.

    The second has (tid, starts, ends): windows starting at starts[i]..ends[i] occur elsewhere as well.
    """
    tid = F.unhex(F.sha2(whole_text().cast("binary"), 256))
    long_texts = docs.select(tid.alias("tid"), whole_text().alias("text")).where(F.octet_length("text") >= length)
    texts = _bucketed(long_texts.groupBy("tid").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "tid", made)
    keyed = texts.select("tid", "text").mapInArrow(_anchor_keys(length), "tid binary, key long, n long")
    shared = keyed.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    wanted = keyed.select("tid", "key").join(shared, "key").groupBy("tid").agg(F.collect_list("key").alias("keys"))
    cut = texts.select("tid", "text").join(wanted, "tid").select("tid", "text", "keys").mapInArrow(_segments(length), SEGMENT)
    segments = shared_table(cut, "segments")
    crowded = segments.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SORT_SEGMENTS).select("key")

    def distinct(some: DataFrame) -> DataFrame:
        whole = some.groupBy("seg").agg(F.first(F.struct("key", "lead", "content", "left", "least", "most")).alias("s"), F.sum(F.size("tids")).alias("seen"))
        return whole.select("seg", "s.*", "seen")

    ranges = distinct(segments.join(crowded, "key", "left_anti")).repartitionByRange("lead", "key").sortWithinPartitions("lead", "key", "seg")
    judged = ranges.select("seg", "key", "content", "left", "least", "most", "seen").mapInArrow(_sorted_buckets(length), "seg binary, `from` array<int>, `to` array<int>")
    if not crowded.isEmpty():
        judged = judged.unionByName(_count_windows(distinct(segments.join(crowded, "key", "left_semi")), length))
    places = segments.select("seg", F.explode(F.arrays_zip("tids", "starts")).alias("p")).select("seg", F.col("p.tids").alias("tid"), F.col("p.starts").alias("at"))
    hits = places.join(judged, "seg").groupBy("tid").agg(
        F.flatten(F.collect_list(F.transform("from", lambda k: k + F.col("at")))).alias("starts"),
        F.flatten(F.collect_list(F.transform("to", lambda k: k + F.col("at")))).alias("ends"),
    )
    return texts, hits


def remove_repeats(docs: DataFrame, length: int = LENGTH, made: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the table,
    in the same text or another; all strings are judged on the input. Strings never span two rows.
    Equal texts are compared once: if a text occurs in two rows, all of it goes (given ``length``
    bytes). A null text is empty. Rows without a doc_id keep their place; an empty table gives no rows.
    The result reads a table in the warehouse, whose name goes to ``made``; it can be dropped when the result has been used.
    """
    texts, hits = repeated_spans(docs, length, [] if made is None else made)
    once = texts.where("copies = 1").select("tid", "text").join(hits, "tid").select("tid", "text", "starts", "ends")
    changed = once.mapInArrow(_cut(length), "tid binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    whole = texts.where("copies > 1").select(
        "tid", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit("").cast("binary").alias("kept")
    )
    raw = whole_text().cast("binary")
    rows = docs.select("doc_id", F.unhex(F.sha2(raw, 256)).alias("tid"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha"), raw.alias("raw"))
    joined = rows.join(changed.unionByName(whole), "tid", "left")
    zero: Column = F.lit(0).cast("long")
    return joined.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("kept", "raw").alias("kept"),
    )


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document when repeated 400-byte strings go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made: list[str] = []
    out = shared_table(remove_repeats(docs, made=made).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), "repeats")
    for name in made:
        spark.sql(f"drop table if exists {name}")
    return out
