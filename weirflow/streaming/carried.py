"""Streams by batches that carry rows over: what a batch plan makes of a table, made of a stream, with late rows in a table of their own.

A batch's rows wait until the watermark (the greatest time seen, less a delay) has passed them. Those that it has passed are computed by the batch plan, with the
rows before them that their windows reach as context. Rows older than the watermark of the batches before go to the table late. All tables lie in one folder, in
a version for each batch: a batch that is run again writes the same version. Versions of the state that no batch needs any more are deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirflow.operators import context, features
from weirflow.operators.context import Rules

SECOND = 1_000_000


@dataclass(frozen=True)
class Batch:
    """What a batch computes on: rows (with done, for those that are only context), the watermark, its number and folder."""

    rows: DataFrame
    mark_us: int
    number: int
    folder: str

    def before(self, name: str) -> DataFrame | None:
        """A table that the batch before wrote."""
        return self.rows.sparkSession.read.parquet(f"{self.folder}/{name}/version={self.number - 1}") if self.number else None

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}/version={self.number}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def forget(self, *names: str) -> None:
        """Deletes what only batches before the last one needed."""
        spark = self.rows.sparkSession
        for name in names:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/version={self.number - 2}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def carried(rows: DataFrame, folder: str, checkpoint: str, compute: Callable[[Batch], None], span_us: int, delay_us: int = 60 * SECOND, ts: str = "ts_us", every: str | None = None) -> StreamingQuery:
    """Runs compute on each batch's rows that the watermark has passed, with the context that a span of time asks for."""

    def step(df: DataFrame, number: int) -> None:
        spark: SparkSession = df.sparkSession
        batch = Batch(df, 0, number, folder)
        clock, state = batch.before("clock"), batch.before("state")
        mark = clock.first()[0] if clock is not None else None
        df = df.persist()
        try:
            old = F.lit(False) if mark is None else F.coalesce(F.col(ts) < mark, F.lit(False))
            batch.write(df.where(old), "late")
            fresh = df.where(~old).withColumn("done", F.lit(False))
            newest = fresh.agg(F.max(ts)).first()[0]
            marks = [m for m in (mark, None if newest is None else newest - delay_us) if m is not None]
            now = max(marks) if marks else None
            pool = fresh if state is None else state.unionByName(fresh)
            passed = F.lit(False) if now is None else F.coalesce(F.col(ts) <= now, F.lit(True))
            kept = pool.where(~passed | (F.col(ts) >= F.lit(now) - span_us)).withColumn("done", F.col("done") | passed) if now is not None else pool
            batch.write(kept, "state")
            compute(Batch(pool.where(passed), now if now is not None else 0, number, folder))
            batch.write(spark.createDataFrame([(now,)], "mark_us long"), "clock")
        finally:
            df.unpersist()
        batch.forget("state", "clock")

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def feature_stream(flows: DataFrame, folder: str, checkpoint: str, delay_us: int = 60 * SECOND, every: str | None = None) -> StreamingQuery:
    """All features of a stream of flows in folder/rows, as in a batch; late flows in folder/late. The state holds a day of flows, the longest window."""

    def compute(batch: Batch) -> None:
        batch.write(features.features(batch.rows).where("not done").drop("done"), "rows")

    return carried(flows, folder, checkpoint, compute, features.DAY, delay_us, every=every)


def _sticky(batch: Batch, hits: DataFrame, rows: DataFrame, ttl_us: int) -> tuple[DataFrame, DataFrame]:
    """The keys that have crossed a threshold (event_type, key, since, seen), and those of them that are new; what no row has asked for in ttl is forgotten."""
    first = hits.groupBy("event_type", "key").agg(F.min(F.struct("ts_us", "seq", "observed")).alias("since"))
    old = batch.before("sticky")
    new = first if old is None else first.join(old.select("event_type", "key"), ["event_type", "key"], "left_anti")
    both = new.withColumn("seen", F.col("since.ts_us"))
    both = both if old is None else old.unionByName(both)
    seen = rows.select(F.explode(F.array("src_ip", "dst_ip")).alias("key"), "ts_us").groupBy("key").agg(F.max("ts_us").alias("last"))
    now = both.join(seen, "key", "left").withColumn("seen", F.greatest("seen", F.coalesce("last", "seen"))).drop("last")
    return batch.write(now.where(F.col("seen") >= batch.mark_us - ttl_us).select("event_type", "key", "since", "seen"), "sticky"), new


def context_stream(scored: DataFrame, folder: str, checkpoint: str, rules: Rules = Rules(), ttl_us: int = 3600 * SECOND, delay_us: int = 60 * SECOND, every: str | None = None) -> StreamingQuery:
    """Context decisions of a stream of scored flows in folder/rows, its events in folder/events, late flows in folder/late.

    A source or destination that has crossed a threshold stays escalated until it has had no row for ttl; its event is given once. Apart from that the results
    are those of context.escalated() and context.events() over all rows.
    """
    spans = (rules.window, rules.ddos_window, rules.fanout_window, rules.burst_window, rules.scan_window, rules.sweep_window, rules.slow_window)
    triggers = context._triggers(rules)

    def compute(batch: Batch) -> None:
        rows = context.measured(batch.rows, rules).where("not done").drop("done")
        rows = batch.write(rows, "measured")
        found = [F.when(F.expr(c), F.struct(F.lit(n).alias("event_type"), F.col(key).alias("key"), F.col(count).cast("long").alias("observed"))) for n, (key, c, count) in triggers.items()]
        hits = rows.select("ts_us", "seq", F.explode(F.array_compact(F.array(*found))).alias("e")).select("e.*", "ts_us", "seq")
        sticky, new = _sticky(batch, hits, rows, ttl_us)
        own = (F.col("suspicious") >= rules.least_events) & F.lit(rules.least_events > 0)
        pair = F.concat_ws("|", "src_ip", "dst_ip", F.col("dst_port").cast("string"))
        raised = rows.where(own & F.col("decision").isin("LOW", "MEDIUM")).select(F.lit("escalation").alias("event_type"), pair.alias("key"), "ts_us", "seq", F.col("suspicious").cast("long").alias("observed"))
        batch.write(raised.unionByName(new.select("event_type", "key", "since.ts_us", "since.seq", "since.observed")), "events")
        out, reasons = rows, [F.when(own, F.lit("escalation"))]
        for side in ("dst_ip", "src_ip"):
            names = [n for n, (key, _, _) in triggers.items() if key == side]
            since = sticky.where(F.col("event_type").isin(names)).groupBy(F.col("key").alias(side)).pivot("event_type", names).agg(F.min(F.struct("since.ts_us", "since.seq")))
            out = out.join(since.withColumnsRenamed({n: f"since_{n}" for n in names}), side, "left")
            reasons += [F.when(_reached(f"since_{n}"), F.lit(n)) for n in names]
        out = out.withColumn("reasons", F.array_compact(F.array(*reasons)))
        out = out.withColumn("context_decision", F.when(F.size("reasons") > 0, "HIGH").otherwise(F.col("decision")))
        batch.write(out.select(*rows.columns, "reasons", "context_decision"), "rows")
        batch.forget("sticky", "measured")

    return carried(scored, folder, checkpoint, compute, int(max(spans) * SECOND), delay_us, every=every)


def _reached(since: str) -> Column:
    at, seq = F.col(f"{since}.ts_us"), F.col(f"{since}.seq")
    return F.coalesce((F.col("ts_us") > at) | ((F.col("ts_us") == at) & (F.col("seq") >= seq)), F.lit(False))
