"""Quality by regularised quadratic discriminant analysis of document statistics.

Each text becomes a vector of transformed statistics. For each class the mean and a covariance shrunk towards the pooled one
and its diagonal are estimated from labelled rows; a text's score comes from the difference of the two log densities, whose
Mahalanobis terms use the inverses of the covariances' Cholesky factors, made once, and from a logistic curve fitted to that difference.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import giving_back, one_text_each, text_blocks
from weirflow.llm.toxicity import fit_logistic

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
FEATURES = (
    "words", "word_length", "capitals", "digits", "symbols", "bangs", "bars", "points", "lines", "repeated_words", "commonest_word", "repeated_lines", "sentence",
)

_LETTER, _UPPER, _DIGIT, _SYMBOL, _BANG, _BAR, _POINT, _LINE, _BLANK, _OTHER = range(10)


def _classes() -> np.ndarray:
    """The class of each code point of the basic plane; others count as letters."""
    out = np.full(0x10000, _LETTER, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if ch == "\n":
            out[c] = _LINE
        elif ch.isspace():
            out[c] = _BLANK
        elif ch in "!?":
            out[c] = _BANG
        elif ch == "|":
            out[c] = _BAR
        elif ch in ".,;:'\"()-":
            out[c] = _POINT
        elif ch in "#*$%&<>@^~=+_/\\[]{}`":
            out[c] = _SYMBOL
        elif ch.isdigit():
            out[c] = _DIGIT
        elif ch.isupper():
            out[c] = _UPPER
        elif not ch.isalpha():
            out[c] = _OTHER
    return out


_table: list[np.ndarray] = []


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, of length FEATURES; defined for the empty text too."""
    if not _table:
        _table.append(_classes())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(_table[0][np.minimum(points, 0xFFFF)], minlength=10)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    chars = max(1, len(text) - int(n[_BLANK] + n[_LINE]))
    counts = Counter(words)
    count = max(1, len(words))
    share = lambda x: float(np.log(x / chars + 0.002))
    return [
        float(np.log1p(len(words))),
        float(np.log(chars / count)),
        share(int(n[_UPPER])),
        share(int(n[_DIGIT])),
        share(int(n[_SYMBOL])),
        share(int(n[_BANG])),
        share(int(n[_BAR])),
        share(int(n[_POINT])),
        share(int(n[_LINE])),
        float(np.log((len(words) - len(counts)) / count + 0.05)),
        float(np.log(max(counts.values(), default=0) / count + 0.01)),
        float(np.log((len(lines) - len(set(lines))) / max(1, len(lines)) + 0.02)),
        float(np.log1p(count / max(1, text.count(".") + text.count("!") + text.count("?")))),
    ]


class Discriminant:
    """Two Gaussians with shrunk covariances; class 1 is the good one."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pool: float = 0.2, diagonal: float = 0.1):
        self.scale = x.std(axis=0) + 1e-3
        x = x / self.scale
        pooled = sum(np.cov(x[y == c].T, bias=True) * (y == c).sum() for c in (0, 1)) / len(y)
        self.means, self.inverse, self.log_det = [], [], []
        for c in (0, 1):
            own = x[y == c]
            spread = (1 - pool) * np.cov(own.T, bias=True) + pool * pooled
            spread = (1 - diagonal) * spread + diagonal * np.diag(np.diag(spread)) + 0.01 * np.eye(x.shape[1])
            factor = np.linalg.cholesky(spread)
            self.means.append(own.mean(axis=0))
            self.inverse.append(np.linalg.inv(factor))
            self.log_det.append(2 * float(np.log(np.diag(factor)).sum()))
        self.curve = np.array([0.0, 1.0])
        self.curve = fit_logistic(np.column_stack([np.ones(len(x)), self._difference(x)]), y.astype(float))

    def _difference(self, scaled: np.ndarray) -> np.ndarray:
        density = [-0.5 * ((((scaled - self.means[c]) @ self.inverse[c].T) ** 2).sum(axis=1) + self.log_det[c]) for c in (0, 1)]
        gap = density[1] - density[0]
        return np.sign(gap) * np.log1p(np.abs(gap))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.curve[0] + self.curve[1] * self._difference(x / self.scale)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Constant:
    """The score where labels have one class only."""

    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant | Constant:
    """A model from at most sample labelled rows, by a hash of doc_id; labels has doc_id and quality (0 or 1)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    @giving_back
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            values = np.array([statistics(t or "") for t in batch.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(values[:, k]) for k in range(len(FEATURES))] + [batch.column("quality")], [*FEATURES, "quality"])

    # At most sample rows, one for each doc_id, of fixed width.
    schema = ", ".join(f"{f} double" for f in FEATURES) + ", quality int"
    points = one_text_each(docs.join(F.broadcast(known), "doc_id"), "doc_id", "quality").select("text", "quality").mapInArrow(measure, schema).toPandas()
    y = points["quality"].to_numpy(int) if len(points) else np.zeros(0, int)
    if min((y == 0).sum(), (y == 1).sum()) < 3:
        return Constant(float((y.sum() + 1) / (len(y) + 2)))
    return Discriminant(points[list(FEATURES)].to_numpy(float), y)


def score(documents: DataFrame, model: Discriminant | Constant) -> DataFrame:
    """doc_id and score (0 to 1, higher: quality 1 likelier) of every row; a null text is empty, rows that repeat are scored each."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            values = np.array([statistics(t or "") for t in batch.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(values), pa.float64())], ["doc_id", "score"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double")


def quality(documents: DataFrame, labels: DataFrame, folds: int = 5, fold_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    documents needs doc_id and text, labels doc_id and quality; other columns are never read. Labels are learned only from rows whose
    crc32 of doc_id as text leaves another remainder than fold_out; a null doc_id is not held out. With fewer than three labels of a
    class every text gets one score.
    """
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string")), F.lit(folds))
    model = learn(documents, labels.where(remainder != fold_out))
    out = score(documents, model)
    return out.select("doc_id", F.coalesce(remainder == fold_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good(documents: DataFrame, labels: DataFrame, folds: int = 5, fold_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """The rows of documents that quality() predicts to be good, all their columns, without a join."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string")), F.lit(folds))
    shared = documents.sparkSession.sparkContext.broadcast(learn(documents, labels.where(remainder != fold_out)))
    place = documents.columns.index("text")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            values = np.array([statistics(t or "") for t in batch.column(place).to_pylist()], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(shared.value.score(values) >= threshold))

    return documents.mapInArrow(run, documents.schema)
