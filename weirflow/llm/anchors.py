"""Content-defined anchors of fixed-width windows, and the exchange that finds those which occur more than once.

A sequence of symbols has a window at each start. Each window is assigned to the leftmost least of its gram hashes, its
anchor; equal windows have equal anchors at the same place, so only occurrences of one anchor need to be compared, and each
window occurrence belongs to exactly one anchor. About two in (width - gram + 2) positions are anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import shard_count, text_blocks, written
from weirflow.llm.ngram_join import mix

#: Symbols in a gram, unless a caller says otherwise: enough that most grams are as rare as what they stand in.
GRAM = 8
#: Places of a block: a text has fewer than 2 ** 31 bytes.
_PLACE = np.uint64((1 << 31) - 1)
_BASE = 0x9E3779B97F4A7C15
_ALL = 0xFFFFFFFFFFFFFFFF
#: Rows of the table of copied texts (32 bytes each) that may be broadcast instead of shuffling the texts.
BROADCAST_ROWS = 500_000


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram that starts at each place, from those of its halves; two that overlap fill up what is no power of two."""
    out, span = codes, 1
    while 2 * span <= gram:
        out = out[: len(out) - span] * np.uint64(pow(_BASE, span, 1 << 64)) + out[span:]
        span *= 2
    if gram > span:
        out = out[: len(out) - (gram - span)] * np.uint64(pow(_BASE, gram, 1 << 64)) + out[gram - span :]
    return mix(out)


def window_anchors(codes: np.ndarray, lengths: np.ndarray, width: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of sequences that lie one after another in codes.

    Returns per anchor: sequence, hash, place, first and last start of its windows; places and starts count from the sequence's start.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    ends = np.cumsum(lengths)
    offsets = ends - lengths
    fits = lengths >= width
    if not fits.any():
        return none
    grams = gram_hashes(codes, gram)
    least, span, count = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1, width - gram + 1
    while 2 * span <= count:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if count > span:
        least = np.minimum(least[: len(least) - (count - span)], least[count - span :])
    inside = np.zeros(len(codes) + 1, np.int8)
    np.add.at(inside, offsets[fits], 1)
    np.add.at(inside, ends[fits] - width + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside, dtype=np.int8)[: len(least)])
    place = (least[starts] & _PLACE).astype(np.int64)
    turn = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    at, first, last = place[turn], starts[turn], starts[np.r_[turn[1:] - 1, len(starts) - 1]]
    sequence = np.searchsorted(offsets, at, "right") - 1
    # Empty sequences share an offset with the next one; the last of them is the one with symbols.
    base = offsets[sequence]
    return sequence, grams[at], at - base, first - base, last - base


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, key, rank, text, d1, d2: key tells different rows apart, rank has the order of doc_ids (null last, beside the largest long), d1 and d2 digest the text.

    The key is a 64-bit hash of doc_id and text, so that nothing has to be numbered; rows that agree in both share it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("d1", F.xxhash64("text")).withColumn("d2", F.xxhash64(F.lit(1), F.col("text")))
    key = F.xxhash64("doc_id", F.col("doc_id").isNull(), "d1", "d2")
    return docs.withColumn("key", key).withColumn("rank", F.coalesce("doc_id", F.lit((1 << 63) - 1)))


def copies(docs: DataFrame) -> DataFrame:
    """d1, d2, stand, n of texts that occur more than once: the least (rank, key) stands for them."""
    return docs.groupBy("d1", "d2").agg(F.min(F.struct("rank", "key")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2", F.col("least.key").alias("stand"), F.col("n").alias("copies"))


def with_copies(docs: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """docs with the columns of a written table of copied texts, null for other texts; that is broadcast only if it was counted and is small."""
    return docs.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, keys, "left")


def with_table(docs: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """docs with the columns of a table by key. Such a table grows with the texts: both sides are shuffled at any size."""
    return docs.join(table.hint("merge"), "key", how)


def _blobs(shard: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """Columns of a block, dealt to shards: for each shard that has rows, its part of all columns one after another."""
    order = np.argsort(shard, kind="stable")
    dealt = shard[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(dealt)) + 1, len(dealt)]
    columns = [c[order] for c in columns]
    return dealt[cuts[:-1]], [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts[:-1], cuts[1:])]


def _parsed(blobs: pa.ChunkedArray, kinds: list[str]) -> list[np.ndarray]:
    """The columns of a shard's blobs, put together."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs.combine_chunks():
        data = memoryview(blob.as_buffer())
        n, at = len(data) // width, 0
        for column, kind in zip(out, kinds):
            column.append(np.frombuffer(data[at : at + n * np.dtype(kind).itemsize], kind))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(out, kinds)]


_ENTRY = ["<u8", "<i8", "<i8", "<u4"]


def _anchor_entries(codes_of: Callable, width: int, gram: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, 2 << 20):
            codes, lengths, _ = codes_of(batch.column("text").to_pylist())
            which, hashes, place, _, _ = window_anchors(codes, lengths, width, gram)
            if not len(which):
                continue
            keys, ranks = (batch.column(c).to_numpy()[which] for c in ("key", "rank"))
            shard = ((hashes.astype(np.uint64) >> np.uint64(34)) % np.uint64(shards)).astype(np.int64)
            shard, blobs = _blobs(shard, [hashes.astype("<u8"), keys.astype("<i8"), ranks.astype("<i8"), place.astype("<u4")])
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(blobs, pa.binary())], ["shard", "blob"])

    return run


def _repeated_anchors(by_rank: bool):
    """Places, by document, of anchors that occur more than once (by_rank: in rows of different rank)."""

    def run(group: pa.Table) -> pa.Table:
        hashes, keys, ranks, places = _parsed(group.column("blob"), _ENTRY)
        order = np.argsort(hashes, kind="stable")
        hashes, keys, ranks, places = hashes[order], keys[order], ranks[order], places[order]
        heads = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        sizes = np.diff(np.r_[heads, len(hashes)])
        many = np.minimum.reduceat(ranks, heads) != np.maximum.reduceat(ranks, heads) if by_rank else sizes > 1
        chosen = np.repeat(many, sizes)
        keys, places = keys[chosen], places[chosen]
        order = np.lexsort((places, keys))
        keys, places = keys[order], places[order]
        if not len(keys):
            return pa.table({"key": pa.array([], pa.int64()), "places": pa.array([], pa.binary())})
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return pa.table({"key": pa.array(keys[heads]), "places": pa.array([p.tobytes() for p in np.split(places, heads[1:])], pa.binary())})

    return run


def repeated_anchors(docs: DataFrame, codes_of: Callable, width: int, gram: int, by_rank: bool) -> DataFrame:
    """key, places (32-bit, in parts) of the anchors of docs (key, rank, text) that occur more than once."""
    blobs = docs.select("key", "rank", "text").mapInArrow(_anchor_entries(codes_of, width, gram, shard_count(docs.sparkSession)), "shard long, blob binary")
    found = blobs.groupBy("shard").applyInArrow(_repeated_anchors(by_rank), "key long, places binary")
    return written(found.groupBy("key").agg(F.collect_list("places").alias("places")), "anchors")


_CONTEXT = ["<i8", "<i8", "<u4", "<u1", "<u4"]


def _contexts(codes_of: Callable, cut: Callable, width: int, gram: int, shards: int):
    """What the windows of repeated anchors cover, dealt to shards by the anchor's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, 2 << 20):
            codes, lengths, bodies = codes_of(batch.column("text").to_pylist())
            which, hashes, place, first, last = window_anchors(codes, lengths, width, gram)
            wanted = [np.frombuffer(b"".join(p), "<u4").astype(np.int64) + (i << 32) for i, p in enumerate(batch.column("places").to_pylist())]
            chosen = np.isin(which * (1 << 32) + place, np.concatenate(wanted))
            which, hashes, first, last = which[chosen], hashes[chosen], first[chosen], last[chosen]
            if not len(which):
                continue
            shard = ((hashes.astype(np.uint64) >> np.uint64(34)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            shard, which, first, last = shard[order], which[order], first[order], last[order]
            keys, ranks, weights = (batch.column(c).to_numpy()[which] for c in ("key", "rank", "weight"))
            pieces = [cut(bodies[w], a, b + width) for w, a, b in zip(which.tolist(), first.tolist(), last.tolist())]
            sizes = np.array([len(p) for p in pieces])
            cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
            columns = [c.astype(k) for c, k in zip((keys, ranks, first, weights, sizes), _CONTEXT)]
            heads = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts[:-1], cuts[1:])]
            bodies_ = [b"".join(pieces[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]]), pa.array(heads, pa.binary()), pa.array(bodies_, pa.binary())], ["shard", "head", "body"])

    return run


def _judged(judge: Callable):
    """judge(distinct contexts, class of each occurrence, rank, weight) gives for each occurrence a mask of its windows."""

    def run(group: pa.Table) -> pa.Table:
        keys, ranks, first, weights, sizes = _parsed(group.column("head"), _CONTEXT)
        body = b"".join(x.as_buffer().to_pybytes() for x in group.column("body").combine_chunks())
        ends = np.cumsum(sizes.astype(np.int64)).tolist()
        classes: dict[bytes, int] = {}
        start, of = 0, np.empty(len(keys), np.int64)
        for i, end in enumerate(ends):
            of[i] = classes.setdefault(body[start:end], len(classes))
            start = end
        masks = judge(list(classes), of, ranks, weights.astype(np.int64))
        hit = masks != 0
        order = np.argsort(keys[hit], kind="stable")
        keys = keys[hit][order]
        if not len(keys):
            return pa.table({"key": pa.array([], pa.int64()), "marks": pa.array([], pa.binary())})
        marks = np.empty(len(keys), _MARK)
        marks["first"], marks["mask"] = first[hit][order], masks[hit][order]
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return pa.table({"key": pa.array(keys[heads]), "marks": pa.array([m.tobytes() for m in np.split(marks, heads[1:])], pa.binary())})

    return run


_MARK = np.dtype([("first", "<u4"), ("mask", "<u8")])


def marked_windows(docs: DataFrame, codes_of: Callable, cut: Callable, width: int, by_rank: bool, judge: Callable, gram: int = GRAM) -> DataFrame:
    """key, marks: for each document with windows that judge marks, their starts as (first, mask) pairs in parts.

    A mask has a bit for each window of an anchor: width is less than gram + 64. docs has key, rank, weight, text. codes_of turns texts into codes, lengths and bodies; cut takes a part of a body as bytes.
    """
    if not gram <= width < gram + 64:
        raise ValueError(f"windows of {width} cannot have grams of {gram}")
    places = repeated_anchors(docs, codes_of, width, gram, by_rank)
    flagged = with_table(docs.select("key", "rank", "weight", "text"), places, "inner")
    parts = flagged.mapInArrow(_contexts(codes_of, cut, width, gram, shard_count(docs.sparkSession)), "shard long, head binary, body binary")
    found = parts.groupBy("shard").applyInArrow(_judged(judge), "key long, marks binary")
    return written(found.groupBy("key").agg(F.collect_list("marks").alias("marks")), "marks")


def covered(marks: list[bytes] | None, length: int, width: int) -> np.ndarray:
    """Which of a document's symbols lie in a marked window."""
    change = np.zeros(length + 1, np.int32)
    if marks:
        pairs = np.frombuffer(b"".join(marks), _MARK)
        bits = (pairs["mask"][:, None] >> np.arange(min(64, width), dtype=np.uint64)) & np.uint64(1)
        row, offset = np.nonzero(bits)
        starts = pairs["first"][row].astype(np.int64) + offset
        np.add.at(change, starts, 1)
        np.add.at(change, starts + width, -1)
    return np.cumsum(change[:-1]) > 0
