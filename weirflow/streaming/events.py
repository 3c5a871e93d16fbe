"""Event streams: files that arrive, late rows, stateful windows, and tables that batches keep up."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from weirflow.operators.sweep import Sweep
from weirflow.sources.eve import parsed


def read_stream(spark: SparkSession, path: str, types: tuple[str, ...] | None = None, files: int | None = None) -> DataFrame:
    """Events of a folder that files are moved into; a rotated log is one more file. seq is a hash of the line, as a stream has no line numbers."""
    reader = spark.readStream.option("maxFilesPerTrigger", files) if files else spark.readStream
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.xxhash64("value", "_metadata.file_path").alias("seq"))
    return parsed(lines, types)


def with_event_time(flows: DataFrame, delay: str = "1 minute") -> DataFrame:
    """flows with event_time and a watermark on it: rows that come later than the delay are left out of stateful results (carried.py keeps them in a table)."""
    return flows.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)


def first_of_id(flows: DataFrame, key: str = "flow_id") -> DataFrame:
    """The first row of each id, as far as the watermark reaches; needs event_time."""
    return flows.dropDuplicatesWithinWatermark([key])


def tumbling(flows: DataFrame, seconds: int, *by: str) -> DataFrame:
    """start, by, n, bytes of windows that follow one another."""
    out = flows.groupBy(F.window("event_time", f"{seconds} seconds"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("total_bytes").alias("bytes"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "bytes")


def swept_stream(flows: DataFrame, sweep: Callable[[], Sweep], schema: StructType | str) -> DataFrame:
    """What a sweep gives on a stream: the same as in a batch, for rows that are not late.

    Rows of a key wait until the watermark has passed them, and are then taken in order. The state is the sweep, whose windows hold no more than their span,
    and the waiting rows; a key that stays quiet is dropped with its timer.
    """
    keys = list(sweep().keys)
    names = list(flows.columns)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = pickle.loads(state.get[0]) if state.exists else (None, None)
        held = held if held is not None else sweep()
        frames = [f for f in [waiting, *batches] if f is not None and len(f)]
        rows = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=names)
        until = state.getCurrentWatermarkMs() * 1000
        ready = rows[rows["ts_us"] <= until].sort_values(["ts_us", "seq"], kind="stable") if len(rows) else rows
        rest = rows[rows["ts_us"] > until] if len(rows) else rows
        if state.hasTimedOut and not len(rest):
            state.remove()
        else:
            state.update((pickle.dumps((held, rest)),))
        if len(ready):
            out = held(ready)
            state_rows = pickle.dumps((held, rest))
            if state.exists:
                state.update((state_rows,))
            yield out.astype({n: "float64" for n in held.names})
        if state.exists:
            last = int(rest["ts_us"].max()) if len(rest) else until + 86_400_000_000
            state.setTimeoutTimestamp(max(last // 1000 + 1, until // 1000 + 1))

    return flows.groupBy(*keys).applyInPandasWithState(step, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def start(df: DataFrame, path: str, checkpoint: str, kind: str = "json", every: str | None = None) -> StreamingQuery:
    """Appends a stream to a table of files; without `every` it takes what is there and ends."""
    writer = df.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def keep_blocks(scored: DataFrame, path: str, checkpoint: str, limits=None, every: str | None = None) -> StreamingQuery:
    """Keeps the table of blocks up to date: each batch's candidates are added to those in force, a new version of the table for each batch.

    A batch that is run again writes the same version. Nothing outside that folder is touched.
    """
    from weirflow.operators.context import BlockLimits, block_list

    limits = limits or BlockLimits()

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        asked = rows.where("action = 'BLOCK'").select("src_ip", "ts_us", "action")
        if number > 0:
            before = spark.read.parquet(f"{path}/version={number - 1}").where("end = 'in force'")
            asked = before.select("src_ip", F.col("blocked_us").alias("ts_us"), F.lit("BLOCK").alias("action")).unionByName(asked)
        block_list(asked, limits).write.mode("overwrite").parquet(f"{path}/version={number}")

    writer = scored.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
