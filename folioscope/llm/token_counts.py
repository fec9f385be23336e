"""Token counts of whole texts: a broadcast table of frequent pre-tokens' lengths, worker caches for all others."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import slices
from folioscope.llm.packing import _PIECES, _PLAIN, WordTokenizer

LIMIT = 2048
#: Entries of the broadcast table and the longest pre-token in it: 65 bytes an entry, two megabytes, at most.
TABLE_PIECES, TABLE_CHARACTERS = 1 << 15, 32
#: Counters that a task keeps while it reads, and those that it hands on.
COUNTERS, HANDED_ON = 1 << 16, 1 << 13
#: Characters of the pre-tokens that a worker keeps with their lengths; the cache starts anew when it is full.
CACHE_CHARACTERS = 6_000_000
#: Bytes of texts and characters of one text that are looked at together.
SLICE_BYTES, PART_CHARACTERS = 1 << 20, 1 << 20

#: Fixed value: the pattern of the tokenizers whose pre-tokens are counted one by one.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_TEXT = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
_STATE: dict = {}


def separable(path: str) -> bool:
    """Whether the tokenizer's pre-tokens can be told apart at white space: its pattern drops it, and its special tokens hold none."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
    split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    told = split.get("pattern", {}).get("Regex") == PATTERN and split.get("behavior") == "Removed"
    marks = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    return kinds == ["NFC", "Replace", "Lowercase"] and told and marks and spec["post_processor"] is None


def parts(text: str, size: int = PART_CHARACTERS) -> Iterator[str]:
    """The text cut at spaces into parts of about ``size`` characters; one word is never cut."""
    at = 0
    while len(text) - at > size and (end := text.find(" ", at + size)) >= 0:
        yield text[at:end]
        at = end
    yield text[at:]


def pre_tokens(text: str) -> tuple[list[str], list[str]]:
    """The pre-tokens of the words that are plain Latin-1, and the other words as they stand."""
    if "<|" not in text and _PLAIN_TEXT.fullmatch(text):
        return _PIECES.findall(text.lower()), []
    words = text.replace("\n", " ").split(" ")
    odd = {w for w in set(words) if w and ("<|" in w or not _PLAIN.fullmatch(w))}
    return _PIECES.findall(" ".join([w for w in words if w not in odd]).lower()), [w for w in words if w in odd]


def thinned(counts: Counter, size: int) -> Counter:
    """A summary of at most ``size`` counters: all lose what the next one has, which errs by at most 1 / size of the total."""
    if len(counts) <= size:
        return counts
    best = counts.most_common(size + 1)
    least = best[-1][1]
    return Counter({p: n - least for p, n in best[:-1] if n > least})


def frequent_pieces(docs: DataFrame, text: str = "text", entries: int = TABLE_PIECES) -> list[str]:
    """The pre-tokens that all documents hold most often, as far as each task's summary tells them.

    A task hands on at most ``HANDED_ON`` counters, however much it reads; no pre-token of the texts is shuffled, only
    these. The choice decides what is looked up first, never a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, "text", SLICE_BYTES):
            for value in batch.column("text").to_pylist():
                for part in parts(value or ""):
                    counts.update(pre_tokens(part)[0])
                    if len(counts) > 4 * COUNTERS:
                        counts = thinned(counts, COUNTERS)
        rows = [(p, n) for p, n in counts.most_common(2 * HANDED_ON) if len(p) <= TABLE_CHARACTERS][:HANDED_ON]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["piece", "n"])

    handed = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "piece string, n long")
    best = handed.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(entries)
    return [r["piece"] for r in best.select("piece").collect()]


class PieceCounter:
    """Counts a text's tokens from its pre-tokens: the table first, then this worker's cache, then the tokenizer."""

    def __init__(self, path: str, pieces: str, lengths: bytes) -> None:
        self.tokenizer = WordTokenizer(path)
        self.table = dict(zip(pieces.split("\n"), lengths)) if lengths else {}
        self.cache: dict[str, int] = {}
        self.held = 0

    def length(self, piece: str) -> int:
        """Tokens of one pre-token, by the tokenizer's model."""
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.tokenizer.bytes)
        return len(self.tokenizer.model.tokenize(shown))

    def _cached(self, keys: list[str], encode: Callable[[str], int]) -> int:
        known = self.cache
        for key in set(keys).difference(known):
            known[key] = encode(key)
            self.held += len(key)
        return sum(map(known.__getitem__, keys))

    def __call__(self, text: str) -> int:
        total, table = 0, self.table
        for part in parts(text):
            if self.held > CACHE_CHARACTERS:
                self.cache.clear()
                self.held = 0
            pieces, odd = pre_tokens(part)
            total += sum(map(table.get, pieces, repeat(0)))
            total += self._cached([p for p in pieces if p not in table], self.length)
            total += self._cached(odd, lambda w: len(self.tokenizer.whole.encode(w, add_special_tokens=False).ids))
        return total


def library_counter(path: str) -> Callable[[str], int]:
    """Counts whole texts by the file's own library: sentencepiece for .model, tokenizers for .json."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return lambda text: len(whole.encode(text, add_special_tokens=False).ids)


def count_tokens(docs: DataFrame, tokenizer_path: str, column: str = "n_tokens", text: str = "text", table: list[str] | None = None) -> DataFrame:
    """``docs`` with the number of tokens of each whole text, without begin, end or other added tokens.

    ``table`` lists the pre-tokens to look up first; without it the most frequent ones of ``docs`` are taken
    (``frequent_pieces``, one more read of the texts). At most ``TABLE_PIECES`` of them, of ``TABLE_CHARACTERS`` at most,
    are broadcast with their lengths. Everything else is encoded where it is read and kept in a cache of bounded size. A tokenizer whose
    pre-tokens cannot be told apart at white space reads whole texts and takes no table.

    A null or empty text has 0 tokens. Special strings within a text are tokens of their own, as the library has it.
    Rows keep their number and all their columns, repeated ones too; a column named like ``column`` is replaced. An
    empty table stays empty. Nothing but the tasks' counters is shuffled.
    """
    docs = docs.drop(column)
    kept = docs.schema.fieldNames()
    at, spark = kept.index(text), docs.sparkSession
    two_tiers = separable(tokenizer_path)
    sent = None
    if two_tiers:
        chosen = frequent_pieces(docs, text) if table is None else sorted({p for p in table if 0 < len(p) <= TABLE_CHARACTERS and _PIECES.fullmatch(p)})[:TABLE_PIECES]
        lengths = bytes(map(PieceCounter(tokenizer_path, "", b"").length, chosen))
        sent = spark.sparkContext.broadcast(("\n".join(chosen), lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer_path, *(sent.value if two_tiers else ()))
        if _STATE.get("key") != key:
            _STATE.update(key=key, count=PieceCounter(*key) if two_tiers else library_counter(tokenizer_path))
        count = _STATE["count"]
        for batch in slices(batches, text, SLICE_BYTES):
            numbers = [count(value) if value else 0 for value in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*kept, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())]))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document's text, and whether the tokens exceed the limit."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
