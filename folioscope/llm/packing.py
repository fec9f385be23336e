"""Order-preserving packing of token streams into fixed windows by dynamic programming."""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import slices

WINDOW = 4096
#: Id put behind each document.
DOCUMENT_END = 2
#: What a cut costs, in padding tokens: behind a document, behind a sentence, elsewhere.
DOCUMENT_CUT, SENTENCE_CUT, TRUNCATION = 0, 4, 24
#: Tokens packed by one run of the dynamic program, and texts tokenised at a time.
BLOCK_TOKENS, SLICE_BYTES = 128 * WINDOW, 1 << 20
#: Characters of the words that a Python worker keeps with their ids; the table starts anew when it is full.
CACHE_CHARACTERS = 6_000_000

# The tokenizer's own pattern, written out for Latin-1: contractions, letters, single numerals, other marks.
_LETTERS, _NUMERALS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMERALS}]|[^\s{_LETTERS}{_NUMERALS}]+")
#: Words for which that pattern, Python's lower case and no normalisation give what the tokenizer gives.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]+")
_STATE: dict = {}


class WordTokenizer:
    """Ids of whole texts by a public tokenizer that treats white space as a mere separator.

    Words of Latin-1 letters, numerals and marks are split by the tokenizer's own pattern and encoded
    by its model; all other words go through the whole tokenizer. Ids are kept by word.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.pieces: dict[str, bytes] = {}
        # the model sees bytes as printable characters: itself for most, from U+0100 on for the rest
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
        rest = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.bytes = {b: rest.get(b, chr(b)) for b in range(256)}
        stops = [i for t, i in self.whole.get_vocab().items() if t[0] in ".!?" and t.endswith("</w>")]
        self.stops = np.zeros(self.whole.get_vocab_size(), bool)
        self.stops[stops] = True

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes)
            ids = self.pieces[piece] = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word or not word:
            return b"".join([self._piece(p) for p in _PIECES.findall(word.lower())])
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the numbers of ids before which a sentence ends."""
        if self.held > CACHE_CHARACTERS:
            self.words.clear()
            self.pieces.clear()
            self.held = 0
        words, known = text.replace("\n", " ").split(" "), self.words
        for word in set(words).difference(known):
            known[word] = self._word(word)
            self.held += len(word)
        ids = np.frombuffer(b"".join([known[w] for w in words]), "<u4")
        return ids, np.flatnonzero(self.stops[ids]) + 1


def cut_windows(n: int, documents: np.ndarray, sentences: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of the windows that cover tokens 0..n-1 at the least cost of padding and cuts.

    A window costs ``window - length`` tokens of padding, nothing at a power of two, plus the price of
    the cut at its end. With best[i] the least cost of the first i tokens, best[j] = min over
    j - window <= i < j of (best[i] + i) + window - j + price(j): a sliding minimum, kept in a
    monotone queue. Points a power of two apart are paired beforehand. All document and sentence ends
    are points; of the other places those that a window, or ``step`` tokens, part from an end.
    """
    if n <= 0:
        return []
    step = max(1, window // 64)
    inside = lambda p: np.unique(p[(p > 0) & (p < n)]).astype(np.int64)
    documents, sentences = inside(documents), inside(sentences)
    priced = np.union1d(documents, sentences)
    # hard cuts: a window behind each end, and a grid between the documents and the first sentence end of each step
    thin = np.union1d(documents, sentences[np.unique(sentences // step, return_index=True)[1]])
    known = np.unique(np.concatenate([[0, n], thin, inside(np.append(thin, 0) + window)]))
    gaps = np.flatnonzero(np.diff(known) > step)
    hard = [np.append(priced, 0) + window, known, *[np.arange(a + step, b, step) for a, b in zip(known[gaps].tolist(), known[gaps + 1].tolist())]]
    # the last tokens may also end in windows of powers of two, which take no padding
    rest, at = n % window, n - n % window
    for k in range(rest.bit_length() - 1, -1, -1):
        hard.append(np.array([at]))
        at += rest & (1 << k)
    places = np.concatenate([[0], np.union1d(priced, inside(np.concatenate(hard))), [n]]).astype(np.int64)
    prices = np.full(len(places), TRUNCATION)
    prices[np.searchsorted(places, sentences)] = SENTENCE_CUT
    prices[np.searchsorted(places, documents)] = DOCUMENT_CUT
    prices[-1] = 0
    # pairs of points a power of two apart, but for whole windows, which the queue sees
    heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in (1 << k for k in range(window.bit_length()) if 1 << k < window):
        i = np.searchsorted(places, places - size)
        heads.append(np.flatnonzero(places[i] == places - size))
        tails.append(i[heads[-1]])
    order = np.argsort(np.concatenate(heads), kind="stable")
    tails = np.concatenate(tails)[order].tolist()
    upto = np.searchsorted(np.concatenate(heads)[order], np.arange(len(places)), "right").tolist()
    points, price = places.tolist(), prices.tolist()
    best, before, seen = [0], [0], 0
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])
    for j in range(1, len(points)):
        p = points[j]
        while queue[0][2] < p - window:
            queue.popleft()
        key, source, _ = queue[0]
        cost = key + window - p
        while seen < upto[j]:
            i = tails[seen]
            seen += 1
            if best[i] < cost:
                cost, source = best[i], i
        cost += price[j]
        best.append(cost)
        before.append(source)
        key = cost + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j, p))
    ends, j = [], len(points) - 1
    while j:
        ends.append(points[j])
        j = before[j]
    return ends[::-1]


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, padded_tokens long, ids binary"
)
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens")]
    + [("ids", pa.binary())]
)


def _pack_block(block: list[tuple[int | None, np.ndarray, np.ndarray]], first_sequence: int, keep_ids: bool) -> tuple[pa.RecordBatch, int]:
    """Pieces of one block of documents and the number of the next sequence."""
    sizes = np.array([len(ids) for _, ids, _ in block], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    total = int(bounds[-1])
    sentences = np.concatenate([s + b for (_, _, s), b in zip(block, bounds)]) if block else np.zeros(0, np.int64)
    ends = np.array(cut_windows(total, bounds[1:], sentences), np.int64)
    cuts = np.unique(np.concatenate([bounds, ends]))
    starts, stops = cuts[:-1], cuts[1:]
    owner = np.searchsorted(bounds, starts, "right") - 1
    window = np.searchsorted(ends, starts, "right")
    opens = np.concatenate([[0], ends[:-1]])
    length = ends - opens
    padded = np.where(length & (length - 1) == 0, length, WINDOW)
    pieces = [np.ascontiguousarray(block[d][1][a - bounds[d] : b - bounds[d]]) for d, a, b in zip(owner.tolist(), starts.tolist(), stops.tolist())]
    columns = [
        pa.array([block[d][0] for d in owner.tolist()], pa.int64()),
        starts - bounds[owner],
        stops - starts,
        np.array([zlib.crc32(p) for p in pieces], np.int64),
        sizes[owner],
        window + first_sequence,
        starts - opens[window],
        length[window],
        padded[window],
        pa.array([p.tobytes() for p in pieces] if keep_ids else [None] * len(pieces), pa.binary()),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_ARROW), first_sequence + len(ends)


def pack(docs: DataFrame, tokenizer_path: str, keep_ids: bool = True) -> DataFrame:
    """Pack every document, whole and in order, into sequences of at most 4096 tokens.

    Each task packs the documents it reads, block by block; nothing is shuffled, and a task holds one
    block of ids. Sequence numbers start at the task's number times 2**40, so they never clash.
    Returns one row per piece: the document's id, where in the document and in the sequence it lies,
    a checksum, the sequence's own and padded length and, unless ``keep_ids`` is off, the ids
    themselves (little-endian, four bytes each).

    A null or empty text is the single id 2. A null doc_id stays null. Repeated rows are packed as
    often as they occur. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _STATE.get("path") != tokenizer_path:
            _STATE.update(path=tokenizer_path, tokenizer=WordTokenizer(tokenizer_path))
        encode = _STATE["tokenizer"].encode
        sequence, held, block = TaskContext.get().partitionId() << 40, 0, []
        for batch in slices(batches, "text", SLICE_BYTES):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids, sentences = encode(text or "")
                block.append((doc_id, np.append(ids, np.uint32(DOCUMENT_END)), sentences))
                held += len(ids) + 1
                if held >= BLOCK_TOKENS:
                    out, sequence = _pack_block(block, sequence, keep_ids)
                    held, block = 0, []
                    yield out
        if block:
            yield _pack_block(block, sequence, keep_ids)[0]

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, without the ids themselves."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids")
