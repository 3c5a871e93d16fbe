"""Sliding windows over the rows before each row.

Rows of a key are ordered by ts and then by seq, a column or several; the window of a row are the rows before it whose ts is at least its own minus the span. Rows of the same
ts that come earlier are in, later ones are not. Sums are taken as the difference of two running sums, one up to the row before and one
of what is older than the span: both grow from the start of the key, so that the cost is linear in the rows however
long the window is, and both use one sort by (key, ts, seq).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def _turns(seq: str | Sequence[str]) -> list[str]:
    return [seq] if isinstance(seq, str) else list(seq)


def prior_sum(value: Column, keys: Sequence[str], span_us: int, ts: str = "ts_us", seq: str | Sequence[str] = "seq") -> Column:
    """The sum of value (an integer, so that differences are exact) over the window of each row."""
    part = Window.partitionBy(*keys)
    before = F.sum(value).over(part.orderBy(ts, *_turns(seq)).rowsBetween(Window.unboundedPreceding, -1))
    older = F.sum(value).over(part.orderBy(ts).rangeBetween(Window.unboundedPreceding, -span_us - 1))
    zero = F.lit(0).cast("long")
    return F.coalesce(before, zero) - F.coalesce(older, zero)


def prior_count(keys: Sequence[str], span_us: int, where: Column | None = None, ts: str = "ts_us", seq: str | Sequence[str] = "seq") -> Column:
    one = F.lit(1) if where is None else F.when(where, 1).otherwise(0)
    return prior_sum(one, keys, span_us, ts, seq)


def with_prior(df: DataFrame, measures: dict[str, tuple[Column, Sequence[str], int]], ts: str = "ts_us", seq: str | Sequence[str] = "seq") -> DataFrame:
    """df with a column for each measure (value, keys, span); measures of one key share a shuffle and a sort."""
    out = df
    for keys in dict.fromkeys(tuple(m[1]) for m in measures.values()):
        out = out.withColumns({name: prior_sum(value, k, span, ts, seq) for name, (value, k, span) in measures.items() if tuple(k) == keys})
    return out


def sliced(df: DataFrame, keys: Sequence[str], span_us: int, slice_us: int, ts: str = "ts_us") -> DataFrame:
    """df with each key cut into slices of time, for keys that hold too many rows for one task.

    Rows get slice (the part of time that a task computes) and context: a row is repeated as context in each later slice that its window
    can reach, so that a window over (keys, slice) is complete for the rows that are not context. slice_us should be at least span_us: then a row is repeated once
    at most.
    """
    own = F.floor(F.col(ts) / slice_us)
    last = F.floor((F.col(ts) + span_us) / slice_us)
    return df.withColumn("slice", F.explode(F.sequence(own, last))).withColumn("context", F.col("slice") != own)


def hot_keys(df: DataFrame, key: str, most: int) -> DataFrame:
    """key of the keys with more than most rows: there are fewer than rows / most of them."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(key)


def spread(df: DataFrame, key: str, hot: DataFrame | None, span_us: int, slice_us: int, ts: str = "ts_us") -> DataFrame:
    """df with slice and context as in sliced(), for the keys in hot; all rows of other keys are in slice 0, and without hot all are."""
    if hot is None:
        return df.withColumns({"slice": F.lit(0).cast("long"), "context": F.lit(False)})
    slice_us = max(slice_us, span_us)
    own, last = (F.floor(x / slice_us).cast("long") for x in (F.col(ts), F.col(ts) + span_us))
    rows = df.join(hot.withColumn("is_hot", F.lit(True)), key, "left")
    rows = rows.withColumn("slice", F.explode(F.when(F.col("is_hot"), F.sequence(own, last)).otherwise(F.array(F.lit(0).cast("long")))))
    return rows.withColumn("context", F.coalesce(F.col("is_hot"), F.lit(False)) & (F.col("slice") != own)).select(*df.columns, "slice", "context")


def swept(df: DataFrame, keys: Sequence[str], schema: StructType | str, sweep: Callable, ts: str = "ts_us", seq: str | Sequence[str] = "seq") -> DataFrame:
    """What a sweep over each key's rows in order gives, for measures that no aggregate can express.

    Rows are dealt by key and sorted by (key, ts, seq); each task runs one sweep() over its Arrow batches, so that a key is never held
    as a whole: the sweep keeps what its windows need and starts anew when the key changes. Only the columns that it reads become Python values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = sweep()
        for batch in batches:
            yield step.batch(batch)

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, ts, *_turns(seq)).mapInArrow(run, schema)


def prior_list(value: Column, keys: Sequence[str], span_us: int, ts: str = "ts_us", seq: str = "seq") -> Column:
    """The values of the window of each row, oldest first: for windows known to be short."""
    part = Window.partitionBy(*keys)
    held = F.collect_list(F.struct(F.col(ts).alias("t"), F.col(seq).alias("s"), value.alias("v"))).over(part.orderBy(ts).rangeBetween(-span_us, 0))
    before = F.filter(held, lambda x: (x["t"] < F.col(ts)) | (x["s"] < F.col(seq)))
    return F.transform(F.sort_array(before), lambda x: x["v"])


def prior_distinct(df: DataFrame, name: str, value: str, keys: Sequence[str], span_us: int, ts: str = "ts_us", seq: str = "seq") -> DataFrame:
    """df with the number of distinct values in the window of each row, by running sums alone.

    A row counts for the windows in which it is the last of its value: from the row after it up to the next row of that value in the key, or to the
    end of its span if that comes first. The distinct values of a window are the spans that have begun less those that have ended.
    """
    same = Window.partitionBy(*keys, value).orderBy(ts, seq)
    next_ts, next_seq = F.lead(ts).over(same), F.lead(seq).over(same)
    rows = df.withColumn("_next_ts", next_ts).withColumn("_next_seq", next_seq)
    by_next = F.coalesce(F.col("_next_ts") <= F.col(ts) + span_us, F.lit(False))
    # An end takes effect after the row at which it is: behind the next row of the value, or behind all rows of the last time in the span.
    start = F.struct(F.col(ts).alias("t"), F.col(seq).cast("long").alias("at"), F.lit(0).alias("order"), F.lit(1).alias("step"))
    end = F.struct(F.when(by_next, F.col("_next_ts")).otherwise(F.col(ts) + span_us).alias("t"), F.when(by_next, F.col("_next_seq").cast("long")).otherwise(F.lit((1 << 63) - 1)).alias("at"), F.lit(1).alias("order"), F.lit(-1).alias("step"))
    # Both come from one row, so that the plan above is there once; only the row itself keeps its columns.
    both = rows.withColumn("_e", F.explode(F.array(start, end)))
    before = Window.partitionBy(*keys).orderBy("_e.t", "_e.at", "_e.order").rowsBetween(Window.unboundedPreceding, -1)
    counted = both.withColumn(name, F.coalesce(F.sum("_e.step").over(before), F.lit(0)))
    return counted.where("_e.order = 0").drop("_e", "_next_ts", "_next_seq")
