"""Helpers that several operators of this folder use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.storage import shared_table  # noqa: F401  (the operators take it from here)

#: Word rule shared by the word-based operators: runs without a space, tab, newline, VT, FF or CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def whole_text(name: str = "text") -> Column:
    """The column's text, empty for null."""
    return F.coalesce(F.col(name), F.lit(""))


def id_fold(name: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, mod 5; 0 marks the held-out fold. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5, F.lit(0))


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores in front as keep it apart from all columns of the frames."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once for each row however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """What ``step`` has gathered before each element of an array, starting from ``zero``.

    Arrays grow by being copied; done in chunks the work stays nearly in proportion to the array's length.
    """
    grow = lambda array, start: F.aggregate(
        array,
        F.struct(F.filter(F.array(zero), lambda x: F.lit(False)).alias("all"), start.alias("now")),
        lambda acc, x: F.struct(F.concat(acc["all"], F.array(acc["now"])).alias("all"), step(acc["now"], x).alias("now")),
        lambda acc: acc["all"],
    )
    pieces = F.transform(F.filter(F.sequence(F.lit(0), F.size(values), F.lit(chunk)), lambda i: i < F.size(values)), lambda i: F.slice(values, i + 1, chunk))
    heads = lambda cut: grow(F.transform(cut, lambda c: F.aggregate(c, zero, step)), zero)
    return let(pieces, lambda cut: F.flatten(F.zip_with(cut, heads(cut), grow)))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one piece take about ``most_bytes`` (one row at least)."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_string()) if batch.num_rows else None
        if texts is None:
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: empty) end to end, and the offset of each row with the total last."""
    texts = column.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; words never cross rows."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_GAP[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift), elementwise."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each byte span, equal for equal bytes wherever they stand."""
    up, down = powers(len(data) + 1), powers(len(data) + 1, _BASE_INVERSE)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
