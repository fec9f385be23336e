"""Toxicity scores from a classifier whose training also penalises score changes when identity terms are swapped."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import id_fold, mix64, shared_table, slices, span_hashes, utf8, whole_text

#: At most so many labelled documents are learned from; those of least hash.
SAMPLE_DOCUMENTS = 8000
#: Leading bytes of a word that are features besides the word, and the numbers of occurrences told apart.
PREFIXES, OCCURRENCES = (4, 5, 6, 7), (1, 2, 4)
#: Features for training: all that at least so many documents hold and whose labels differ by so many standard deviations.
LEAST_DOCUMENTS, LEAST_DEVIATION = 3, 4.0
STEPS, RATE, RIDGE, SWAP_PENALTY = 300, 0.05, 2e-3, 4.0
SLICE_BYTES = 1 << 20

#: Words that name groups of people, by language and number; each stands for any other of its line in a counterfactual text.
IDENTITY_TERMS = tuple(
    tuple(line.split())
    for line in (
        "women men muslims christians jews hindus immigrants refugees gays lesbians asians africans europeans americans mexicans germans blacks whites",
        "woman man muslim christian jew hindu immigrant refugee lesbian asian african european american mexican german",
        "frauen männer muslime christen juden einwanderer flüchtlinge schwule lesben asiaten afrikaner europäer amerikaner türken",
        "frau mann moslem christ jude einwanderin flüchtling lesbe asiate afrikanerin europäerin amerikanerin türke",
        "femmes hommes musulmans chrétiens juifs hindous immigrés réfugiés homosexuels lesbiennes asiatiques africains européens américains",
        "femme homme musulman chrétien juif hindou immigré réfugié homosexuel lesbienne asiatique africain européen américain",
        "mujeres hombres musulmanes cristianos judíos hindúes inmigrantes refugiados homosexuales lesbianas asiáticos africanos europeos americanos",
        "mujer hombre musulmán cristiano judío hindú inmigrante refugiado homosexual lesbiana asiático africano europeo americano",
    )
)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with the capitals of ASCII and Latin-1 made small."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 0x20
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all texts, distinct: hashed words and word beginnings, each by how often they occur."""
    data, offsets = utf8(texts)
    data = lowered(data)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTER[data]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = (np.searchsorted(offsets, starts, "right") - 1).astype(np.uint64)
    rows, names = [row], [span_hashes(data, starts, ends)]
    for k in PREFIXES:
        long = ends - starts > k
        rows.append(row[long])
        names.append(mix64(span_hashes(data, starts[long], starts[long] + k) + np.uint64(k)))
    rows, names = np.concatenate(rows), np.concatenate(names)
    order = np.argsort(names, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    rows, names = rows[order], names[order]
    fresh = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (names[1:] != names[:-1])])) if len(rows) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([fresh, [len(rows)]]))
    rows, names = rows[fresh], names[fresh]
    out = [(rows[times >= c], names[times >= c] if c == 1 else mix64(names[times >= c] + np.uint64(1000 + c))) for c in OCCURRENCES]
    return np.concatenate([r for r, _ in out]).astype(np.int64), np.concatenate([n for _, n in out])


def swap_terms(text: str, spot: int, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> str | None:
    """The text with each identity term replaced by another one of its line, or None if it holds none."""
    places: dict[str, tuple[tuple[str, ...], int]] = {}
    for line in terms:
        for k, term in enumerate(line):
            places.setdefault(term, (line, k))
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, places), reverse=True)) + r")\b", re.IGNORECASE)

    def other(m: re.Match) -> str:
        line, k = places[m[0].lower()]
        return line[(k + 1 + spot % max(len(line) - 1, 1)) % len(line)]

    out, n = pattern.subn(other, text)
    return out if n else None


@dataclass
class Model:
    """Weights of the kept features, sorted by feature."""

    names: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        row, name = features(texts)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
            known = self.names[at] == name
            np.add.at(total, row[known], self.weights[at[known]])
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(spot, text, toxic) of at most SAMPLE_DOCUMENTS labelled documents outside the held-out fold.

    The labels are thinned by their hash before they meet the texts. An id that occurs again counts once, with its
    least text and greatest label.
    """
    able = labels.where((id_fold() != 0) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    able = able.withColumn("spot", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    chosen = able.orderBy("spot", "doc_id").limit(SAMPLE_DOCUMENTS)
    texts = docs.where("text is not null").select("doc_id", "text").join(chosen.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return chosen.join(texts, "doc_id").select("spot", "text", "toxic")


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        row, name = features(batch.column("text"))
        toxic = np.array(batch.column("toxic").to_pylist(), np.int64)[row]
        names, inverse = np.unique(name, return_inverse=True)
        bad = np.bincount(inverse, weights=toxic, minlength=len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(inverse, minlength=len(names)).astype(np.int64)), pa.array(bad)], names=["name", "n", "bad"])


class Hits:
    """A 0/1 matrix of texts and features, as the places of its ones."""

    def __init__(self, lists: list[np.ndarray], width: int) -> None:
        self.shape = len(lists), width
        self.row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.column = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.shape[0])

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=v[self.row], minlength=self.shape[1])


def _train(x: Hits, y: np.ndarray, left: Hits, right: Hits) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam; pairs (left, right) of texts and counterfactuals should score alike.

    Loss: mean cross entropy + SWAP_PENALTY * mean (score difference)**2 + RIDGE / 2 * |w|**2. The bias comes last.
    """
    width, pairs = x.shape[1], left.shape[0]
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    score = lambda a: 1 / (1 + np.exp(-np.clip(a.times(w[:-1]) + w[-1], -60, 60)))
    back = lambda a, e: np.append(a.transposed_times(e), e.sum())
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for step in range(1, STEPS + 1):
        g = back(x, score(x) - y) / len(y) + RIDGE * np.append(w[:-1], 0)
        if pairs:
            a, b = score(left), score(right)
            g += 2 * SWAP_PENALTY * (back(left, (a - b) * a * (1 - a)) - back(right, (a - b) * b * (1 - b))) / pairs
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Model:
    """A model learned from the bounded sample; without labels of both kinds a constant score.

    What reaches the driver are the features of at most SAMPLE_DOCUMENTS texts, as numbers.
    """
    sample = shared_table(training_sample(docs, labels), "sample")
    n, bad = sample.agg(F.count("*"), F.sum("toxic")).first()
    bad = int(bad or 0)
    none = np.zeros(0, np.uint64)
    if not n or not bad or bad == n:
        return Model(none, np.zeros(0), float(np.log((bad + 0.5) / (n - bad + 1.0))))
    counts = sample.mapInArrow(_feature_counts, "name long, n long, bad long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rate = bad / n
    deviation = (F.col("bad") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) * (1 - F.col("n") / (n + 1.0)))
    kept = counts.where((F.col("n") >= LEAST_DOCUMENTS) & (F.abs(deviation) >= LEAST_DEVIATION)).select("name")
    names = np.sort(np.array([r["name"] for r in kept.collect()], np.int64).view(np.uint64))
    if not len(names):
        return Model(none, np.zeros(0), float(np.log((bad + 0.5) / (n - bad + 0.5))))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            spots = batch.column("spot").to_pylist()
            swapped = [swap_terms(t, s, terms) for t, s in zip(batch.column("text").to_pylist(), spots)]
            out = []
            for texts in (batch.column("text"), pa.array(swapped, pa.string())):
                row, name = features(texts)
                at = np.minimum(np.searchsorted(names, name), len(names) - 1)
                known = names[at] == name
                order = np.argsort(row[known], kind="stable")
                row, at = row[known][order], at[known][order].astype("<i4")
                ends = np.searchsorted(row, np.arange(len(spots) + 1))
                out.append([at[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])
            out[1] = [f if s is not None else None for f, s in zip(out[1], swapped)]
            columns = [batch.column("spot"), batch.column("toxic").cast(pa.int32()), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["spot", "toxic", "own", "swapped"])

    rows = sorted(sample.mapInArrow(hits, "spot long, toxic int, own binary, swapped binary").collect(), key=lambda r: (r["spot"], r["toxic"], bytes(r["own"])))
    table = lambda lists: Hits([np.frombuffer(x, "<i4") for x in lists], len(names))
    paired = [r for r in rows if r["swapped"] is not None]
    weights, bias = _train(table([r["own"] for r in rows]), np.array([r["toxic"] for r in rows], float), table([r["own"] for r in paired]), table([r["swapped"] for r in paired]))
    return Model(names, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score in 0..1, predicted (1 from 0.5 on).

    The whole text is scored; a null or empty one has no feature and gets the base rate. Each row is
    judged by itself; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("text")))], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels)).select("doc_id", (id_fold() == 0).alias("held_out"), "score", "predicted")
