"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters and digit substitutions to plain letters and punctuation to spaces. Lexicon
terms are whole words or starts of words, learned from labelled rows: candidates come from toxic texts, their counts from
all texts of the sample, and a term stays when the lower confidence bound of its log odds is high enough. Exception phrases
are learned from the same rows: a matched word with its neighbours, where several clean texts have that phrase and no toxic one. A word
counts once, with the largest weight of the terms that match it, unless it lies in an exception phrase. The sum, plain and
normalised by length, goes through a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import Scratch, one_text_each, text_blocks

#: Letters of other scripts that look like Latin ones, and substitutions in disguised words.
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁԛԝαεικνορτυχ", "abekmhopctyxijsdqwaeikvoptux")
DISGUISES = str.maketrans("013457@$", "oieastas")

_FOLD = {ord(c): " " for c in string.punctuation + string.whitespace + "\x1c\x1d\x1e\x1f\x85\xa0«»“”„‘’…–—¿¡"}
_FOLD |= {0xFF01 + i: chr(0x21 + i) if chr(0x21 + i).isalnum() else " " for i in range(94)}
_FOLD |= {ord(c): None for c in "­​‌‍⁠﻿"}
_FOLD |= LOOKALIKES | DISGUISES

#: Lengths of word starts that can be terms.
STARTS = (4, 5, 6)
#: Rows that the lexicon is learned from, candidates whose counts are taken, terms that are kept.
SAMPLE, CANDIDATES, TERMS = 20_000, 20_000, 4_000
#: Clean texts that a phrase must be in to be an exception, and exceptions that are kept.
PHRASE_TEXTS, PHRASES = 3, 2_000


def fold(text: str) -> str:
    """text as folded words, with one space at each side of each word."""
    return f" {' '.join(text.lower().translate(_FOLD).lower().split())} "


def terms_of(folded: str) -> set[str]:
    """The terms of a text: " word " for words and " start" for their starts."""
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in STARTS if len(word) >= n)
    return found


class Lexicon:
    """Weighted terms and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: tuple[float, ...]):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                made.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                made.add_word(phrase, (len(phrase), None))
            if len(made):
                made.make_automaton()
            self._automaton = made
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """The weight of each matched word of a folded text, by the place of the space before it."""
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if len(self.automaton):
            for end, (length, weight) in self.automaton.iter(folded):
                start = end - length + 1
                if weight is None:
                    spared.append((start, end))
                elif weight > hits.get(start, 0.0):
                    hits[start] = weight
        if hits and spared:
            hits = {s: w for s, w in hits.items() if not any(a <= s < b for a, b in spared)}
        return hits

    def phrases(self, folded: str) -> set[str]:
        """Each matched word with its neighbours: both, the one before it, the one after it."""
        words, found = folded.split(), set()
        for start in self.hits(folded):
            i = folded.count(" ", 0, start + 1) - 1
            for a, b in ((i - 1, i + 2), (i - 1, i + 1), (i, i + 2)):
                if a >= 0 and b <= len(words):
                    found.add(f" {' '.join(words[a:b])} ")
        return found

    def features(self, text: str) -> tuple[float, float, float]:
        """The sum of the weights of matched words: whether there is one, damped, and by length."""
        folded = fold(text)
        total = sum(self.hits(folded).values())
        return float(total > 0), float(np.log1p(total)), float(np.log1p(100 * total / (folded.count(" ") + 10)))

    def score(self, text: str) -> float:
        z = float(np.dot(self.curve, (1.0, *self.features(text))))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients by Newton's method with a ridge on all but the intercept; x has a column of ones first."""
    beta, penalty = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - penalty * beta
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _count(terms, wanted: frozenset[str] | None):
    """Document counts of terms(folded text) by label in a task: of toxic rows' terms, or of the wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in text_blocks(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = terms(fold(text or ""))
                counts[toxic].update(found if wanted is None else found & wanted)
        names = sorted(set(counts[0]) | set(counts[1]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][t] for t in names], pa.int64()), pa.array([counts[0][t] for t in names], pa.int64())], ["term", "toxic", "clean"])

    return run


def _words_digest(text_column: str):
    """A digest of a text's lower-case words in their order: copies that differ in case or white space agree, other texts do not."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text_column), "\\s+", " ")), 256)


def learn(documents: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), sample: int = SAMPLE) -> Lexicon:
    """A lexicon from labelled rows: labels has doc_id and toxic (0 or 1), at most sample of them are used, by a hash of doc_id.

    Copies with one label count once, so that a family of copies is no evidence by its size; the row of the least doc_id stands for them. exceptions are
    phrases besides the learned ones.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most sample rows, one for each doc_id.
    rows = one_text_each(docs.join(F.broadcast(known), "doc_id"), "doc_id", "toxic").groupBy(_words_digest("text"), "toxic").agg(F.min(F.struct("doc_id", "text")).alias("least"))
    with Scratch(documents.sparkSession) as scratch:
        return _learned(scratch.written(rows.select("least.text", "toxic"), "labelled"), exceptions)


def _learned(rows: DataFrame, exceptions: tuple[str, ...]) -> Lexicon:
    """A lexicon from a written table of text and toxic."""
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    least = max(4, bad // 200)
    schema = "term string, toxic long, clean long"
    top = rows.where("toxic = 1").mapInArrow(_count(terms_of, None), schema).groupBy("term").agg(F.sum("toxic").alias("toxic")).where(F.col("toxic") >= least)
    wanted = frozenset(r.term for r in top.orderBy(F.col("toxic").desc(), "term").limit(CANDIDATES).collect())
    counted = rows.mapInArrow(_count(terms_of, wanted), schema).groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).collect()
    weights = {}
    for r in counted:
        odds = np.log((r.a + 0.5) / (bad - r.a + 0.5)) - np.log((r.b + 0.5) / (good - r.b + 0.5))
        spread = np.sqrt(1 / (r.a + 0.5) + 1 / (r.b + 0.5))
        if odds - 2 * spread > 1.0 and r.a >= 4 * r.b * (bad + 1) / (good + 1):
            weights[r.term] = float(odds - spread)
    weights = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:TERMS])
    spared = [f" {' '.join(fold(e).split())} " for e in exceptions]
    plain = Lexicon(weights, [], ())
    phrases = rows.mapInArrow(_count(plain.phrases, None), schema).groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    learned = phrases.where((F.col("a") == 0) & (F.col("b") >= PHRASE_TEXTS)).orderBy(F.col("b").desc(), "term").limit(PHRASES).collect()
    lexicon = Lexicon(weights, sorted({*spared, *(r.term for r in learned)}), ())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            values = [lexicon.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in values], pa.float64()) for k in range(3)] + [batch.column("toxic")], ["a", "b", "c", "toxic"])

    points = rows.mapInArrow(measure, "a double, b double, c double, toxic int").toPandas()
    x = np.column_stack([np.ones(len(points)), points[["a", "b", "c"]].to_numpy(float)])
    y = points["toxic"].to_numpy(float)
    curve = fit_logistic(x, y) if len(set(y)) == 2 else np.array([-3.0 if not y.any() else 3.0, 0.0, 0.0, 0.0])
    lexicon.curve = tuple(map(float, curve))
    return lexicon


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier) of every row; a null text is empty, rows that repeat are scored each."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shared.value.score(t or "") for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double")


def toxicity(documents: DataFrame, labels: DataFrame, folds: int = 3, fold_out: int = 1, threshold: float = 0.7, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    documents needs doc_id and text, labels doc_id and toxic; other columns are never read. Labels are learned only from rows whose
    crc32 of doc_id as text leaves another remainder than fold_out; a null doc_id is not held out. Without labels of both kinds every
    text gets one score. Null and empty texts get the score of a text without matches.
    """
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string")), F.lit(folds))
    lexicon = learn(documents, labels.where(remainder != fold_out), exceptions)
    out = score(documents, lexicon)
    return out.select("doc_id", F.coalesce(remainder == fold_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
