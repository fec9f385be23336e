"""Language identification by a bidirectional gated recurrent network over bytes, written and trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import id_fold, slices, utf8, whole_text

HIDDEN = 8
#: Bytes of a window; texts are cut into such windows, every byte lies in one.
SPAN = 128
#: The training sample: documents for each language, passages of each, characters of a passage.
SAMPLE_DOCUMENTS, SAMPLE_PASSAGES, PASSAGE = 192, 3, 64
STEPS, BATCH, RATE, SEED = 240, 96, 0.02, 11
WINDOWS_AT_ONCE = 1024
SLICE_BYTES = 1 << 20
UNKNOWN = "und"


@dataclass
class Network:
    """Weights; the first axis of each recurrent one is the direction (forward, backward).

    ``byte`` maps a byte to the three gates' inputs (update, reset, candidate), ``loop`` the state to the
    same three, ``out`` both states to the languages.
    """

    languages: list[str]
    byte: np.ndarray  # 2, 257, 3H; row 256 is padding
    loop: np.ndarray  # 2, H, 3H
    out: np.ndarray  # 2H, languages
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.byte, self.loop, self.out, self.bias]


def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    return Network(languages, draw(2, 257, 3 * hidden), draw(2, hidden, 3 * hidden), draw(2 * hidden, len(languages)), np.zeros(len(languages), np.float32))


def _gate(x: np.ndarray) -> np.ndarray:
    """The piecewise linear sigmoid: x / 4 + 1/2, held within 0 and 1; in place."""
    x *= 0.25
    x += 0.5
    np.maximum(x, 0, out=x)
    return np.minimum(x, 1, out=x)


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign, x / (1 + |x|); in place."""
    scale = np.abs(x)
    scale += 1
    x /= scale
    return x


def states(net: Network, codes: np.ndarray, keep: bool = False):
    """Hidden states (T, 2, N, H) of windows ``codes`` (N, T); the backward ones in reading order of their direction."""
    n, length = codes.shape
    h = net.loop.shape[1]
    ahead, behind = np.ascontiguousarray(codes.T), np.ascontiguousarray(codes[:, ::-1].T)
    kind = net.byte.dtype
    out, steps = np.empty((length, 2, n, h), kind), []
    state, given, looped = np.zeros((2, n, h), kind), np.empty((2, n, 3 * h), kind), np.empty((2, n, 3 * h), kind)
    for t in range(length):
        net.byte[0].take(ahead[t], 0, out=given[0], mode="clip")
        net.byte[1].take(behind[t], 0, out=given[1], mode="clip")
        np.matmul(state, net.loop, out=looped)
        gates = _gate(given[..., : 2 * h] + looped[..., : 2 * h])
        update, reset = gates[..., :h], gates[..., h:]
        cand = reset * looped[..., 2 * h :]
        cand += given[..., 2 * h :]
        _squash(cand)
        if keep:
            steps.append((state, update, reset, cand, looped[..., 2 * h :].copy()))
        now = np.subtract(state, cand, out=out[t])
        now *= update
        now += cand
        state = now
    return (out, np.stack([ahead, behind], 1), steps) if keep else out


def _joined(out: np.ndarray) -> np.ndarray:
    """(T, N, 2H): both directions' states at each position."""
    return np.concatenate([out[:, 0], out[::-1, 1]], -1)


def position_probabilities(net: Network, codes: np.ndarray) -> np.ndarray:
    """(languages, T, N): the probability of each language at each byte."""
    out = states(net, codes)
    length, _, n, h = out.shape
    logits = np.empty((len(net.languages), length, n), out.dtype)
    for t in range(length):
        np.matmul(net.out[:h].T, out[t, 0].T, out=logits[:, t])
        logits[:, t] += net.out[h:].T @ out[length - 1 - t, 1].T
    logits += net.bias[:, None, None]
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits


def gradients(net: Network, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all real positions, and its gradients by backpropagation through time."""
    out, both, steps = states(net, codes, keep=True)
    length, _, n, h = out.shape
    joined = _joined(out)
    logits = joined @ net.out + net.bias
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(-1, keepdims=True)
    real = (codes.T != 256).astype(np.float32)
    total = max(float(real.sum()), 1.0)
    picked = np.take_along_axis(p, np.broadcast_to(labels[None, :, None], (length, n, 1)), 2)[..., 0]
    loss = float(-(np.log(picked + 1e-9) * real).sum() / total)
    error = p
    np.put_along_axis(error, np.broadcast_to(labels[None, :, None], (length, n, 1)), picked[..., None] - 1, 2)
    error *= (real / total)[..., None]
    g_out = joined.reshape(-1, 2 * h).T @ error.reshape(-1, error.shape[-1])
    g_bias = error.sum((0, 1))
    back = error @ net.out.T
    above = np.stack([back[..., :h], back[::-1, :, h:]], 1)  # T, 2, N, H in each direction's own order
    g_byte, g_loop, d_state = np.zeros_like(net.byte), np.zeros_like(net.loop), np.zeros((2, n, h), net.byte.dtype)
    for t in range(length - 1, -1, -1):
        before, update, reset, cand, looped = steps[t]
        d = d_state + above[t]
        d_cand = d * (1 - update) * (1 - np.abs(cand)) ** 2
        d_update = d * (before - cand) * (0.25 * ((update > 0) & (update < 1)))
        d_reset = d_cand * looped * (0.25 * ((reset > 0) & (reset < 1)))
        d_loop = np.concatenate([d_update, d_reset, d_cand * reset], -1)
        d_given = np.concatenate([d_update, d_reset, d_cand], -1)
        g_loop += before.transpose(0, 2, 1) @ d_loop
        for k in (0, 1):
            np.add.at(g_byte[k], both[t, k], d_given[k])
        d_state = d * update + d_loop @ net.loop.transpose(0, 2, 1)
    return loss, [g_byte, g_loop, g_out, g_bias]


def train(languages: list[str], codes: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit a network to labelled windows with Adam, drawing the languages evenly."""
    net, rng = fresh(languages, seed=seed), np.random.default_rng(seed)
    pools = [np.flatnonzero(labels == k) for k in range(len(languages))]
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        kind = rng.integers(0, len(languages), BATCH)
        rows = np.array([pools[k][rng.integers(0, len(pools[k]))] for k in kind])
        _, grads = gradients(net, codes[rows], labels[rows])
        rate = RATE * (1 - 0.9 * step / steps)
        for w, g, m, v in zip(net.weights(), grads, first, second):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def windows(data: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in rows of ``span`` codes (256 pads the last window of a text), and each window's text."""
    sizes = np.diff(offsets)
    counts = -(-sizes // span)
    row = np.repeat(np.arange(len(sizes)), counts)
    begin = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * span
    place = begin[:, None] + np.arange(span)
    past = place >= offsets[row + 1][:, None]
    codes = data[np.minimum(place, max(len(data) - 1, 0))].astype(np.int16)
    codes[past] = 256
    return codes, row


def training_sample(docs: DataFrame) -> DataFrame:
    """(lang, passage): a bounded sample of the labelled documents outside the held-out fold.

    For each language up to SAMPLE_DOCUMENTS documents, those of least hash, and of each SAMPLE_PASSAGES
    passages of PASSAGE characters at hashed places anywhere in its text. Passages are cut where the texts
    are read, and each task keeps its first few by language before anything is moved.
    """
    able = docs.where((id_fold() != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    able = able.select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("spot"))
    place = lambda k: F.pmod(F.xxhash64("spot", k), F.greatest(F.length("text") - PASSAGE, F.lit(0)) + 1).cast("int") + 1
    passages = F.transform(F.sequence(F.lit(1), F.lit(SAMPLE_PASSAGES)), lambda k: F.substring("text", place(k), F.lit(PASSAGE)))
    cut = able.select("lang", "spot", passages.alias("passages"))
    order = Window.partitionBy("lang").orderBy("spot", "passages")
    first = cut.withColumn("at", F.row_number().over(order)).where(F.col("at") <= SAMPLE_DOCUMENTS)
    return first.select("lang", "at", F.posexplode("passages").alias("k", "passage")).orderBy("lang", "at", "k").select("lang", "passage")


def fit(docs: DataFrame) -> Network | None:
    """A network trained on the sample; None without any labelled text."""
    rows = training_sample(docs).collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    data, offsets = utf8(pa.array([r["passage"] for r in rows]))
    codes, row = windows(data, offsets, PASSAGE)
    labels = np.array([languages.index(r["lang"]) for r in rows])[row]
    full = (codes != 256).sum(1) > PASSAGE // 2
    return train(languages, codes[full], labels[full]) if full.any() else train(languages, codes, labels)


def label(docs: DataFrame, net: Network | None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score, n_positions, n_agreeing.

    Every byte of a text gets a distribution over the languages; the document's is their mean, its
    language the likeliest (ties to the first in order), ``score`` the mean probability and
    ``n_agreeing`` the number of bytes whose own label is that language. Texts that are null, empty or
    without a letter are ``und`` with score 0, and so is everything if nothing could be learned.
    """
    languages = net.languages if net else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            data, offsets = utf8(batch.column("text"))
            n, sizes = batch.num_rows, np.diff(offsets)
            sums, votes = np.zeros((n, max(len(languages), 1))), np.zeros((n, max(len(languages), 1)), np.int64)
            if net is not None:
                codes, row = windows(data, offsets)
                for at in range(0, len(row), WINDOWS_AT_ONCE):
                    c, r = codes[at : at + WINDOWS_AT_ONCE], row[at : at + WINDOWS_AT_ONCE]
                    p = position_probabilities(net, c)
                    pad = c.T == 256
                    best = p.argmax(0)
                    if pad.any():
                        p[:, pad], best[pad] = 0, -1
                    np.add.at(sums, r, p.sum(1).T)
                    for k in range(len(languages)):
                        np.add.at(votes[:, k], r, (best == k).sum(0))
            known = (sizes > 0) & (net is not None)
            top = sums.argmax(1)
            rows = np.arange(n)
            score = np.where(known, sums[rows, top] / np.maximum(sizes, 1), 0.0)
            names = [languages[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), known.tolist())]
            columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(sizes), pa.array(votes[rows, top])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "n_positions", "n_agreeing"])

    lettered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(whole_text().rlike(r"\p{L}"), F.col("text")).otherwise("").alias("text"))
    return lettered.mapInArrow(run, "doc_id long, lang_pred string, score double, n_positions long, n_agreeing long")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = label(docs, fit(docs))
    return found.select("doc_id", (id_fold() == 0).alias("held_out"), "lang_pred", "score", "n_positions", "n_agreeing")
