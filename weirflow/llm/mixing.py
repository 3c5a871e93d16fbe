"""Mixing sources to target weights: capped targets, Sainte-Lague quotas of blocks for sources and their shards, seeded choice of blocks.

Every document is taken in whole rounds, as often as its source's target allows. What is then missing is a number of blocks of equal size, which go one by one to the
source with the highest quotient of its missing words, and a source's blocks in the same way to its shards by their words. A shard's documents
stand in a seeded order and are cut into blocks there; a seeded permutation of the blocks says which ones are taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.llm.common import SPACE, fresh, giving_back, text_blocks, written

WEIGHTS = (3, 1, 2)
#: Words of a shard, about; the smallest and the largest block; between them a block is a FINENESS-th of all words.
SHARD, LEAST, BLOCK, FINENESS = 1 << 18, 16, 512, 1 << 11
#: A prime above any number of blocks in a shard, so that its multiples permute them.
_STEP = 2_147_483_647
#: Rows of a table of doc_id, digest and plan that may be broadcast (72 bytes each).
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    """Number of words: separators between words, when the ends are trimmed."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, budget: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source (null a source too): source, source_size, target.

    The budget times the size of all is shared by weight; a target stops at most times its source's size and what is
    beyond goes to the others by weight, until none is above. That is the level L at which the sums of
    min(most * size, L * weight) reach the budget; it is found from running sums in the order of size / weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    choices = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.element_at(choices, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("whole", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("level", (F.col("whole") - F.col("capped")) / F.col("weight_left"))
        .withColumn("free", F.col("cap") / F.col("weight") > F.col("level"))
    )
    # The first source whose cap is above the level that is left for it fixes the level for all after it.
    level = F.min(F.when(F.col("free"), F.struct(F.col("capped"), F.col("level"))))
    ranked = ranked.withColumn("found", level.over(everything))
    target = F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("found.level") * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def sainte_lague(seats: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Apportions whole blocks: seats has keys and blocks (a count), weights has keys, part and weight.

    Returns weights' rows with quota: the blocks go one by one to the part with the highest quotient
    weight / (2 * quota + 1). A part's quota differs by less than the number of parts from blocks * weight / total,
    so only quotients near the last one that wins are listed: all those surely won are counted by arithmetic, and the
    few left are ranked (ties by part).
    """
    totals = weights.groupBy(*keys).agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("parts"))
    joined = weights.join(totals, keys).join(seats, keys)
    # A quotient is won for sure where it is above total / (2 * blocks - parts), as fewer than blocks quotients are above that.
    bound = lambda n: F.greatest(F.lit(0), F.floor((F.col("weight") * n / F.col("total") + 1) / 2)).cast("long")
    low = F.greatest(F.lit(0.0), 2.0 * F.col("blocks") - F.col("parts"))
    sure = F.when((low > 0) & (F.col("weight") > 0), bound(low)).otherwise(F.lit(0).cast("long"))
    joined = joined.withColumn("sure", sure).where("weight > 0")
    # From there each part lists the quotients that can still win.
    most = F.least(F.col("blocks"), bound(2.0 * F.col("blocks") + F.col("parts")) + 1)
    near = joined.withColumn("most", F.greatest(F.col("sure"), most)).withColumn("k", F.explode_outer(F.when(F.col("most") > F.col("sure"), F.sequence(F.col("sure"), F.col("most") - 1))))
    left = joined.groupBy(*keys).agg((F.first("blocks") - F.sum("sure")).alias("left"))
    rank = Window.partitionBy(*keys).orderBy((F.col("weight") / (2 * F.col("k") + 1)).desc_nulls_last(), "part", "k")
    won = near.withColumn("rank", F.row_number().over(rank)).join(left, keys)
    return won.groupBy(*keys, "part").agg((F.first("sure") + F.sum(F.when(F.col("k").isNotNull() & (F.col("rank") <= F.col("left")), 1).otherwise(0))).alias("quota"))


def mix(documents: DataFrame, budget: float = 1.5, most: float = 2.0, block: int | None = None, shard: int = SHARD, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted).

    documents needs doc_id, text and source; other columns are ignored. A null text has size 0; a null source is a
    source of its own, last in order. Every document is taken floor(target / source size) times; the blocks that are then missing are dealt
    to sources and shards by Sainte-Lague, and a document is taken once more as far as it lies in chosen blocks. A shard has about shard words,
    so that shards follow the data. Rows that repeat a doc_id each count with their own size. Reruns agree, as nothing depends on the layout of partitions
    except the order among rows that are equal in doc_id and text. An empty table gives an empty result.
    """
    return _placed(_sized(documents), budget, most, block, shard, seed).select("doc_id", "source", "size", "source_size", "target", "taken")


def _sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size and a digest of the row's text, as a written table: texts are counted once."""
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("digest"), word_count(text).alias("size"))
    return written(rows, "sizes")


def _placed(sizes: DataFrame, budget: float, most: float, block: int | None, shard: int, seed: int) -> DataFrame:
    """A table of doc_id, source, digest and size with taken, and what fixes the words that are taken: rounds, ahead (words before the row in its shard), block, blocks (of the shard), quota, turn."""
    totals = source_targets(sizes, budget, most).withColumn("key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    totals = totals.withColumn("rounds", rounds).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    # A row for each source: block is one number for all of them.
    everything = Window.partitionBy()
    fine = F.greatest(F.lit(LEAST), F.least(F.lit(BLOCK), F.floor(F.sum("source_size").over(everything) / FINENESS))).cast("long")
    totals = totals.withColumn("block", F.lit(block).cast("long") if block else fine).withColumn("shards", F.ceil(F.col("source_size") / shard).cast("long"))
    totals = written(totals, "targets")
    seats = totals.agg(F.round(F.sum("rest") / F.first("block")).cast("long").alias("blocks")).withColumn("all", F.lit(0))
    won = sainte_lague(seats, totals.select(F.lit(0).alias("all"), F.col("key").alias("part"), F.col("rest").alias("weight")), ["all"])
    seats = won.select(F.col("part").alias("key"), F.col("quota").alias("blocks"))
    draw = lambda k: F.xxhash64(F.lit(seed + k), "doc_id", "digest")
    rows = sizes.withColumn("key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    rows = rows.join(totals.select("key", "source_size", "target", "rounds", "block", "shards"), "key")
    rows = rows.withColumn("part", F.pmod(draw(0), F.greatest(F.col("shards"), F.lit(1))))
    weights = rows.groupBy("key", "part").agg(F.sum("size").alias("weight"))
    # A shard cannot give more blocks than it has; what rounding leaves over is less than a block for each shard.
    quotas = sainte_lague(seats, weights, ["key"])
    quotas = quotas.join(weights, ["key", "part"]).select("key", "part", "quota", "weight")
    rows = rows.join(quotas, ["key", "part"], "left").withColumn("quota", F.coalesce("quota", F.lit(0).cast("long"))).withColumn("blocks", F.ceil(F.coalesce("weight", F.lit(0)) / F.col("block")))
    along = Window.partitionBy("key", "part").orderBy(draw(1), "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(along), F.lit(0).cast("long"))).withColumn("turn", F.pmod(F.xxhash64(F.lit(seed + 2), "key", "part"), F.lit(_STEP)))
    first, last = F.floor(F.col("ahead") / F.col("block")), F.floor((F.col("ahead") + F.col("size") - 1) / F.col("block"))
    chosen = lambda k: F.pmod(k * F.lit(_STEP) + F.col("turn"), F.col("blocks")) < F.col("quota")
    inside = lambda k: F.least(F.col("ahead") + F.col("size"), (k + 1) * F.col("block")) - F.greatest(F.col("ahead"), k * F.col("block"))
    more = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda n, k: n + F.when(chosen(k), inside(k)).otherwise(0).cast("long"))
    more = F.when((F.col("size") > 0) & (F.col("quota") > 0), more).otherwise(0)
    return rows.withColumn("taken", (F.col("rounds") * F.col("size") + more).cast("long"))


_PLAN = ("size", "rounds", "ahead", "block", "blocks", "quota", "turn")


def chosen_words(size: int, rounds: int, ahead: int, block: int, blocks: int, quota: int, turn: int) -> list[tuple[int, int]]:
    """The runs of a document's words, from and to, that lie in chosen blocks of its shard."""
    runs: list[tuple[int, int]] = []
    if not size or not quota:
        return runs
    for k in range(ahead // block, (ahead + size - 1) // block + 1):
        if (k * _STEP + turn) % blocks < quota:
            a, b = max(0, k * block - ahead), min(size, (k + 1) * block - ahead)
            if runs and runs[-1][1] == a:
                runs[-1] = runs[-1][0], b
            else:
                runs.append((a, b))
    return runs


def _taken_texts(place: int, chars: int | None):
    """Rows with each text as often as it is taken whole, and once with its chosen words."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(f"[^{SPACE}]+")
        for batch in text_blocks_at(batches, place):
            texts = batch.column(place).to_pylist()
            plans = zip(*(batch.column(batch.num_columns - len(_PLAN) + k).to_pylist() for k in range(len(_PLAN))))
            rows, bodies = [], []
            for i, (text, plan) in enumerate(zip(texts, plans)):
                runs = chosen_words(*plan)
                mine = [text] * (plan[1] if plan[0] else 0)
                if runs == [(0, plan[0])]:
                    mine.append(text)
                elif runs:
                    spans = [m.span() for m in word.finditer(text)]
                    mine.append(" ".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs))
                bodies += mine
                rows += [i] * len(mine)
            out = batch.take(pa.array(rows, pa.int64()))
            columns = list(out.columns[: -len(_PLAN)])
            columns[place] = pa.array(bodies, pa.string())
            if chars is not None:
                columns[chars] = pa.array([len(b) for b in bodies], pa.int64()).cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, out.schema.names[: -len(_PLAN)])

    return run


def text_blocks_at(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """text_blocks() for batches whose texts are in a column of any name, or share theirs with others."""
    names = None
    for batch in batches:
        names = batch.schema.names
        plain = pa.RecordBatch.from_arrays(batch.columns, ["text" if k == place else str(k) for k in range(batch.num_columns)])
        for part in text_blocks(iter([plain])):
            yield pa.RecordBatch.from_arrays(part.columns, names)


def mixed(documents: DataFrame, budget: float = 1.5, most: float = 2.0, block: int | None = None, shard: int = SHARD, seed: int = 7) -> DataFrame:
    """The mix itself, in documents' columns: a row for each time a text is taken, and one with its words in chosen blocks where those are not all of it; n_chars follows.

    Rows are told apart by doc_id and text: of rows that agree in both, each is taken as often as the one of them that stands first. Rows without words are never taken.
    """
    plan = _placed(_sized(documents), budget, most, block, shard, seed).where("taken > 0")
    by = [fresh(documents, n) for n in ("plan_doc", "plan_digest", "plan")]
    plan = written(plan.groupBy(F.col("doc_id").alias(by[0]), F.col("digest").alias(by[1])).agg(F.min(F.struct("ahead", *[c for c in _PLAN if c != "ahead"])).alias(by[2])), "plan")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(by[0])) & (F.xxhash64(F.col("text").cast("string")) == F.col(by[1]))
    rows = documents.join(F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan, same)
    names = documents.columns
    chars = names.index("n_chars") if "n_chars" in names else None
    parts = [F.col(f"{by[2]}.{c}").alias(fresh(documents, f"plan_{c}")) for c in _PLAN]
    return rows.select(*[documents[c] for c in names], *parts).mapInArrow(_taken_texts(names.index("text"), chars), documents.schema)
