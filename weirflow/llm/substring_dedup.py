"""Removal of word windows that occur more than once, decided by an FM-index for each shard.

Windows are dealt to shards by their anchors (see anchors), so that all occurrences of a window meet in one shard. There the distinct pieces of
text are indexed: superwords of seven words are the symbols, and of all phases only the Burrows-Wheeler transform stays, in a
wavelet matrix of packed bits, with one more bit for each suffix that tells whether its piece occurs more than once. The pieces are then
streamed through the index in blocks: backward search gives the matching statistic of every place, the longest run of symbols that ends there and
has two occurrences or more. Where that reaches the threshold, five symbols for 35 words, the window is reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.anchors import GRAM, copies, covered, keyed, marked_windows, with_copies, with_table
from weirflow.llm.common import text_blocks, written
from weirflow.llm.ngram_join import WordHashes, mix


#: Places of the pieces that are streamed through the index at a time.
BLOCK = 1 << 17


class BitVector:
    """Packed bits with counts before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.zeros = len(bits) - int(counts.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = []
        for bit in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> bit) & 1
            self.levels.append((bit, BitVector(bits.astype(np.uint8))))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each symbol's occurrences before low and high, as places that differ by their number, and the start of the symbol's run."""
        run = np.zeros_like(low)
        for bit, vector in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b, c = vector.ones(low), vector.ones(high), vector.ones(run)
            low = np.where(one, vector.zeros + a, low - a)
            high = np.where(one, vector.zeros + b, high - b)
            run = np.where(one, vector.zeros + c, run - c)
        return low - run, high - run


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes in the order of their first depth symbols, by doubling."""
    rank, span = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while span < depth:
        _, rank = np.unique(rank, return_inverse=True)
        after = np.zeros(len(text), np.int64)
        after[: len(text) - span] = rank[span:] + 1
        rank = rank * (len(text) + 2) + after
        order = np.argsort(rank, kind="stable")
        span *= 2
    return order


class FMIndex:
    """Backward search over a text of symbols from 1 up, 0 the end of a sequence; suffixes are sorted to depth symbols.

    heavy tells which places of the text count twice. Neither the text nor the suffix array is kept.
    """

    def __init__(self, text: np.ndarray, depth: int, heavy: np.ndarray | None = None):
        order = sorted_suffixes(text, depth)
        alphabet = int(text.max(initial=0)) + 1
        self.depth = depth
        self.starts = np.r_[0, np.cumsum(np.bincount(text, minlength=alphabet))]
        self.matrix = WaveletMatrix(text[order - 1], alphabet)
        self.heavy = BitVector((heavy[order] if heavy is not None else np.zeros(len(order))).astype(np.uint8))

    def _step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.matrix.rank(symbol, low, high)
        return self.starts[symbol] + a, self.starts[symbol] + b

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high - low + self.heavy.ones(high) - self.heavy.ones(low)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each row of patterns (at most depth symbols)."""
        low, high = self.starts[patterns[:, -1]], self.starts[patterns[:, -1] + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            low, high = self._step(patterns[:, k], low, high)
        return low, high

    def statistics(self, text: np.ndarray, ends: np.ndarray, least: int = 2) -> np.ndarray:
        """For each place of ends, the longest run of symbols of text that ends there and has at least so many occurrences, up to depth.

        A place is searched on only as long as its run has them.
        """
        out = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        low, high = self.starts[text[ends]], self.starts[text[ends] + 1]
        for k in range(self.depth):
            if k:
                symbol = text[ends[live] - k]
                whole = symbol > 0  # runs do not go beyond the end of a sequence
                live, low, high, symbol = live[whole], low[whole], high[whole], symbol[whole]
                low, high = self._step(symbol, low, high)
            enough = self.occurrences(low, high) >= least
            live, low, high = live[enough], low[enough], high[enough]
            out[live] = k + 1
        return out


def superword(width: int) -> int:
    """Words in a symbol: the divisor of width nearest to 7."""
    return min((d for d in range(1, width + 1) if width % d == 0), key=lambda d: (abs(d - 7), d))


def repeated_windows(pieces: list[bytes], width: int, weights: np.ndarray) -> list[np.ndarray]:
    """For each piece, which of its windows occur twice or more among all pieces, counted with the pieces' weights."""
    q = superword(width)
    words: dict[bytes, int] = {}
    split = [[words.setdefault(w, len(words)) for w in p.split(b" ")] for p in pieces]
    lengths = np.array([len(s) for s in split])
    codes = np.concatenate([np.array(s, np.uint64) for s in split])
    grams = np.zeros(len(codes) - q + 1, np.uint64)
    for k in range(q):
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(grams)] + np.uint64(1))
    ends = np.cumsum(lengths)
    # All phases of a piece: its superwords in the order of (place mod q, place), an end after each phase.
    piece = np.repeat(np.arange(len(pieces)), lengths)
    place = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
    whole = np.flatnonzero(place + q <= np.repeat(lengths, lengths))
    phases = np.stack([np.repeat(np.arange(len(pieces)), q), np.tile(np.arange(q), len(pieces)), np.full(len(pieces) * q, 1 << 40)])
    items = np.concatenate([np.stack([piece[whole], place[whole] % q, place[whole]]), phases], axis=1)
    _, symbols = np.unique(grams[whole], return_inverse=True)
    symbols = np.concatenate([symbols + 1, np.zeros(phases.shape[1], np.int64)])
    order = np.lexsort((items[2], items[1], items[0]))
    text, owner, start = symbols[order], items[0][order], items[2][order]
    depth = width // q
    index = FMIndex(text, depth, weights[owner] >= 2)
    out = [np.zeros(max(0, n - width + 1), bool) for n in lengths.tolist()]
    # A window ends where its last superword begins; the first of its five begins that much earlier.
    ends = np.flatnonzero((start < 1 << 40) & (start >= width - q))
    for block in range(0, len(ends), BLOCK):
        part = ends[block : block + BLOCK]
        found = part[index.statistics(text, part) >= depth]
        for i, s in zip(owner[found].tolist(), (start[found] - (width - q)).tolist()):
            out[i][s] = True
    return out


def _codes(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    bodies = [(t or "").encode().split() for t in texts]
    lengths = np.array([len(b) for b in bodies], np.int64)
    codes = np.fromiter((hashes[w] for b in bodies for w in b), np.uint64, int(lengths.sum()))
    return codes, lengths, bodies


class WordCodes:
    """Texts as words and their hashes, with a cache of its own in each task."""

    def __init__(self):
        self.hashes = None

    def __getstate__(self):
        return {"hashes": None}

    def __call__(self, texts: list[str | None]):
        if self.hashes is None:
            self.hashes = WordHashes()
        return _codes(texts, self.hashes)


def _judge(width: int):
    def judge(pieces: list[bytes], of: np.ndarray, ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.bincount(of, weights, minlength=len(pieces)).astype(np.int64)
        masks = [sum(1 << k for k in np.flatnonzero(r).tolist()) for r in repeated_windows(pieces, width, total)]
        return np.array(masks, np.uint64)[of]

    return judge


def _kept(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            rows = []
            for text, copied, marks in zip(batch.column("text").to_pylist(), batch.column("copied").to_pylist(), batch.column("marks").to_pylist()):
                words = (text or "").encode().split()
                if copied and len(words) >= width:
                    kept: list[bytes] = []
                elif marks:
                    gone = covered(marks, len(words), width)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    kept = words
                rows.append((len(words), len(words) - len(kept), b" ".join(kept)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()), pa.array([r[2].decode() for r in rows], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def without_repeats(documents: DataFrame, width: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    documents needs doc_id and text; other columns are ignored. Words are split at ASCII white space and left as they are. Every
    word covered by a window of width consecutive words that starts anywhere else too, in any document, is removed; kept words are
    joined by one space. A null or empty text has no words. Rows that repeat (any doc_id, null too) are
    occurrences of their own, so that equal texts of width words or more lose everything. An empty table gives an empty result.
    """
    docs = keyed(documents)
    twice = written(copies(docs), "copies")
    marked = with_copies(docs, twice, ["d1", "d2"])
    # Of equal texts one takes part, with a weight of two.
    alone = marked.where("stand is null or key = stand").withColumn("weight", F.when(F.col("stand").isNull(), 1).otherwise(2))
    windows = marked_windows(alone, WordCodes(), lambda body, a, b: b" ".join(body[a:b]), width, False, _judge(width), min(GRAM, width))
    rows = marked.select("doc_id", "key", "text", F.col("stand").isNotNull().alias("copied"))
    rows = with_table(rows, windows, "left")
    return rows.select("doc_id", "text", "copied", "marks").mapInArrow(_kept(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
