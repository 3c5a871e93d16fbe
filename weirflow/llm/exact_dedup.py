"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is a pair of polynomials in its bytes modulo two 31-bit primes. Two neighbouring pieces
combine as H(a + b) = H(a) * base ** len(b) + H(b), so a long text is hashed in pieces and the pieces' values are put
together by arithmetic alone: the pieces of a text beyond LONG bytes are dealt to many tasks. Rows of equal fingerprint and length are
candidates; the pieces of their texts are then compared bytewise, piece by piece, in a sort-based aggregation that never holds a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.llm.common import SPACE_CHARS, Scratch, fresh, giving_back, text_blocks, written

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Bytes in a piece: a byte times a residue, summed over a piece, stays below 2 ** 63.
PIECE = 1 << 18
#: Bytes of a text from which on its pieces are hashed apart.
LONG = 1 << 22
#: Rows of a key table that may be broadcast (24 bytes each).
BROADCAST_ROWS = 500_000

_powers: dict[tuple[int, int], np.ndarray] = {}


def _power_table(base: int, prime: int) -> np.ndarray:
    """base ** 0 to base ** PIECE - 1 modulo prime, by doubling."""
    if (base, prime) not in _powers:
        table = np.ones(1, np.uint64)
        while len(table) < PIECE:
            step = np.uint64(pow(base, len(table), prime))
            table = np.concatenate([table, table * step % np.uint64(prime)])
        _powers[base, prime] = table[:PIECE]
    return _powers[base, prime]


def piece_hash(piece: bytes, which: int, prime: int | None = None) -> int:
    """The polynomial of one piece of at most PIECE bytes."""
    prime = prime or PRIMES[which]
    powers = _power_table(BASES[which], prime)
    values = np.frombuffer(piece, np.uint8).astype(np.uint64)
    values += np.uint64(1)  # so that leading zero bytes count
    return int(np.dot(values, powers[: len(values)][::-1]) % np.uint64(prime))


def combine(left: int, right: int, right_length: int, which: int, prime: int | None = None) -> int:
    """The polynomial of two neighbouring pieces from theirs: the left one is shifted by the right one's length."""
    prime = prime or PRIMES[which]
    return (left * pow(BASES[which], right_length, prime) + right) % prime


def fingerprint(data: bytes, primes: tuple[int, int] = PRIMES) -> tuple[int, int]:
    """Both polynomials of data, combined from those of its pieces."""
    out = [0, 0]
    for start in range(0, len(data), PIECE):
        piece = data[start : start + PIECE]
        for which in (0, 1):
            out[which] = combine(out[which], piece_hash(piece, which, primes[which]), len(piece), which, primes[which])
    return out[0], out[1]


_DELETE = SPACE_CHARS.encode()
_PRINTS = "doc_id long, code_points long, fp_a long, fp_b long, length long, text_sha256 string"
_PIECES = "fp_a long, fp_b long, length long, piece_no long, piece binary"


def _normalised(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode().translate(None, _DELETE) for t in batch.column("text").to_pylist()]


def _prints(primes: tuple[int, int]):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            bodies = _normalised(batch)
            marks = [fingerprint(b, primes) for b in bodies]
            lengths = pc.fill_null(pc.cast(pc.utf8_length(batch.column("text")), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    lengths,
                    pa.array([m[0] for m in marks], pa.int64()),
                    pa.array([m[1] for m in marks], pa.int64()),
                    pa.array([len(b) for b in bodies], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()),
                ],
                ["doc_id", "code_points", "fp_a", "fp_b", "length", "text_sha256"],
            )

    return run


def _pieces(primes: tuple[int, int], size: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            rows: list[tuple] = []
            for body in _normalised(batch):
                a, b = fingerprint(body, primes)
                rows += [(a, b, len(body), k // size, body[k : k + size]) for k in range(0, len(body), size)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["fp_a", "fp_b", "length", "piece_no", "piece"])

    return run


_MARK = "row long, fp_a long, fp_b long, length long"


def _piece_marks(primes: tuple[int, int]):
    """The polynomials and length of each piece (columns row, no, piece) without its white space."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [p.translate(None, _DELETE) for p in batch.column("piece").to_pylist()]
            marks = [pa.array([piece_hash(b, k, primes[k]) for b in bodies], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("no"), pa.array([len(b) for b in bodies], pa.int64()), *marks], ["row", "no", "size", "a", "b"])

    return run


def _combined(primes: tuple[int, int]):
    """A text's polynomials and length from those of its pieces in order (columns row, pieces)."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, pieces in zip(batch.column("row").to_pylist(), batch.column("pieces").to_pylist()):
                a = b = length = 0
                for p in pieces:
                    a, b = combine(a, p["a"], p["size"], 0, primes[0]), combine(b, p["b"], p["size"], 1, primes[1])
                    length += p["size"]
                rows.append((row, a, b, length))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], ["row", "fp_a", "fp_b", "length"])

    return run


def _pieces_of(rows: DataFrame, data, size: int, *keep: str) -> DataFrame:
    """keep, no and piece: the binary column data in pieces of size bytes."""
    last = F.floor((F.octet_length(data) - 1) / size)
    return rows.withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(*keep, "no", F.substring(data, (F.col("no") * size + 1).cast("int"), F.lit(size)).alias("piece"))


def long_marks(long: DataFrame, primes: tuple[int, int], piece: int) -> DataFrame:
    """row, fp_a, fp_b, length of texts (row, text) that are hashed by many tasks: pieces are dealt out, and their values put together."""
    pieces = _pieces_of(long, F.col("text").cast("binary"), piece, "row").repartition("row", "no")
    made = pieces.mapInArrow(_piece_marks(primes), "row long, no long, size long, a long, b long")
    # A list as long as a text has pieces; rows that repeat add nothing to a set.
    whole = made.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("no", "size", "a", "b"))).alias("pieces"))
    return whole.mapInArrow(_combined(primes), _MARK)


def exact_groups(documents: DataFrame, primes: tuple[int, int] = PRIMES, piece: int = 1 << 16, long: int = LONG) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text.

    documents needs doc_id and text; other columns are ignored. Texts are equal when they are the same after the white
    space characters are deleted; a null text counts as empty, and all empty texts are equal. In a group the row with
    the most code points stays, then the smallest doc_id (a null doc_id comes last); of rows that repeat one doc_id in
    a group, one stays. Texts of more than long bytes are hashed and compared in pieces by many tasks. An empty table gives an empty result.
    """
    keys = ["fp_a", "fp_b", "length"]
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    large = F.coalesce(F.octet_length("text") > long, F.lit(False))
    # Rows that agree in doc_id and text share a key, and all that follows from it.
    huge = docs.where(large).withColumn("row", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    squeezed = F.translate("text", SPACE_CHARS, "")
    with Scratch(documents.sparkSession) as scratch:
        prints = docs.where(~large).mapInArrow(_prints(primes), _PRINTS)
        any_huge = not huge.limit(1).isEmpty()
        if any_huge:
            marks = scratch.written(long_marks(huge, primes, min(piece, PIECE)), "marks")
            own = huge.select("row", "doc_id", F.length("text").cast("long").alias("code_points"), F.sha2(squeezed, 256).alias("text_sha256"))
            prints = prints.unionByName(own.join(marks, "row").drop("row"))
        prints = written(prints, "prints")
        shared = scratch.written(prints.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and length > 0").drop("n"), "shared")
        candidates = docs.where(~large).select("text").mapInArrow(_pieces(primes, piece), _PIECES)
        if any_huge:
            texts = huge.join(marks, "row").withColumn("data", squeezed.cast("binary"))
            candidates = candidates.unionByName(_pieces_of(texts, F.col("data"), piece, *keys).withColumnRenamed("no", "piece_no"))
        some = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
        # Pieces of candidates, compared in a streaming fold: equal groups have one smallest and largest piece at each place.
        unequal = (
            candidates.join(some, keys, "left_semi")
            .groupBy(*keys, "piece_no")
            .agg((F.min("piece") != F.max("piece")).alias("differs"))
            .where("differs")
            .select(*keys)
            .distinct()
            .withColumn("split", F.lit(True))
        )
        unequal = written(unequal, "unequal")
    # Where fingerprints collide, the digest of the text splits the group; elsewhere it is left out of the key.
    marked = prints.join(unequal, keys, "left").withColumn("part", F.when(F.col("split"), F.col("text_sha256")).otherwise(""))
    groups = marked.groupBy(*keys, "part").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("code_points")).alias("order"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("best"),
    )
    out = marked.join(groups, [*keys, "part"]).withColumn("best_row", F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("code_points") == -F.col("best.order")))
    # Only rows that could stay are numbered: all of them repeat one doc_id, so that in a table of unique ids each has its own group.
    rest = out.where("not best_row").withColumn("kept", F.lit(False))
    repeat = Window.partitionBy(*keys, "part", "doc_id").orderBy("code_points")
    best = out.where("best_row").withColumn("kept", F.row_number().over(repeat) == 1)
    result = ["doc_id", F.col("best.id").alias("keep_id"), "group_size", "kept", "text_sha256"]
    return best.select(*result).unionByName(rest.select(*result))


def dedup(documents: DataFrame, **options) -> DataFrame:
    """The rows of documents that stay, all their columns, one row for each group. Rows that repeat both doc_id and text count as one.

    Null and empty texts are one group, of which one row stays; of texts equal but for white space the longest stays, then the smallest doc_id.
    """
    doc, sha = fresh(documents, "group_doc"), fresh(documents, "group_sha")
    groups = written(exact_groups(documents, **options).select(F.col("doc_id").alias(doc), F.col("text_sha256").alias(sha), "kept"), "groups")
    repeated = groups.groupBy(doc, sha).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = written(repeated.where("not kept").select(doc, sha), "gone")
    digest = F.sha2(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE_CHARS, ""), 256)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (digest == F.col(sha))
    out = documents.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS // 4 else gone, same, "left_anti")
    if not repeated.where("kept and n > 1").limit(1).isEmpty():
        out = out.withColumn(sha, digest).dropDuplicates(["doc_id", sha]).drop(sha)
    return out
