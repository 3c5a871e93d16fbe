"""Token counts by a table of frequent pre-token lengths and worker caches, without a shuffle of pre-tokens.

In a SentencePiece BPE vocabulary where no piece has the space mark after another character, merges never cross from a
word into the next space, so a text's count is the sum of its words' counts. Line ends are cut off in the same way when no
piece holds one. Both conditions are read from the vocabulary; where one fails, and for texts with other runs of spaces,
the whole text is encoded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import text_blocks

#: Pre-tokens in the broadcast table, in a task's summary, and in each half of a worker's cache.
TABLE, SUMMARY, CACHE = 32_768, 4_096, 150_000

_models: dict[str, object] = {}


def model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def separable(path: str) -> bool:
    """Whether words and lines can be counted apart: the conditions on the vocabulary."""
    m = model(path)
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        if "\n" in piece or "▁" in piece[1:] and piece.strip("▁"):
            return False
    return m.encode("a b") == m.encode("a") + m.encode("b")


def words(text: str) -> list[str] | None:
    """Pre-tokens: words between single spaces, a line end at the start of one; None if spaces or line ends run together."""
    parts = text.replace("\n", " \n").split(" ")
    return None if "" in parts else parts


class Lengths(dict):
    """Token counts by pre-token: misses are encoded and kept in two halves, of which the older is dropped when full."""

    def __init__(self, frequent: dict[str, int], path: str):
        super().__init__(frequent)
        self.path, self.frequent, self.older = path, frequent, {}

    def __missing__(self, word: str) -> int:
        count = self.older.get(word)
        if count is None:
            # A word after a line end has no space before it; the mark that the encoder puts there is not counted.
            count = len(model(self.path).encode(word)) - (word[0] == "\n")
        if len(self) >= len(self.frequent) + CACHE:
            self.older = {k: v for k, v in self.items() if k not in self.frequent}
            self.clear()
            self.update(self.frequent)
        self[word] = count
        return count


def count_text(text: str, lengths: Lengths, apart: bool = True) -> int:
    if not text:
        return 0
    parts = words(text) if apart else None
    if parts is None:
        return len(model(lengths.path).encode(text))
    return sum(map(lengths.__getitem__, parts))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's most frequent pre-tokens; the counter drops its rarer half whenever it is full."""
    counts: Counter[str] = Counter()
    for batch in text_blocks(batches):
        for text in batch.column("text").to_pylist():
            counts.update(words(text or "") or ())
        if len(counts) > 8 * SUMMARY * 4:
            counts = Counter(dict(counts.most_common(4 * SUMMARY)))
    top = counts.most_common(SUMMARY)
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])


def frequent_words(documents: DataFrame) -> list[str]:
    """At most TABLE pre-tokens, from at most SUMMARY of each task; only these summaries move."""
    found = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(_summaries, "word string, n long")
    top = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(TABLE)
    return [r.word for r in top.collect()]


def token_counts(documents: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    documents needs doc_id and text; other columns are ignored. A null text counts as empty: 0 bytes, 0 tokens. Rows that
    repeat are counted each. path is a SentencePiece model that every executor can read. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    apart = separable(path)
    frequent = {w: len(model(path).encode(w)) - (w[0] == "\n") for w in frequent_words(documents)} if apart else {}
    shared = spark.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(shared.value, path)
        for batch in text_blocks(batches):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array([count_text(t or "", lengths, apart) for t in texts], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    out = docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
