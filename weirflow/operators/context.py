"""What a row's neighbours in time say about it: escalations, and the list of blocked sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.operators.features import in_slices
from weirflow.operators.sweep import Around
from weirflow.operators.windows import hot_keys, prior_sum, spread

SECOND = 1_000_000


@dataclass(frozen=True)
class Rules:
    """Spans in seconds and thresholds; a threshold of 0 turns a rule off."""

    window: float = 600
    suspicious: float = 0.30
    least_events: int = 3
    ddos_window: float = 10
    ddos_flows: int = 100
    ddos_sources: int = 50
    fanout_window: float = 120
    fanout_ports: int = 20
    fanout_velocity: float = 0.0
    burst_window: float = 20
    burst_flows: int = 100
    scan_window: float = 30
    scan_ports: int = 20
    sweep_window: float = 60
    sweep_hosts: int = 10
    slow_window: float = 600
    slow_ports: int = 30


def measured(df: DataFrame, rules: Rules = Rules(), hot_rows: int | None = None, slice_us: int = 3600 * SECOND) -> DataFrame:
    """df (seq, ts_us, src_ip, dst_ip, dst_port, risk) with the counts that the rules look at, the row itself included.

    Sources and destinations are swept once each. With hot_rows, those with more rows than that are cut into slices of time; df should then be a table.
    """
    key, us = ("src_ip", "dst_ip", "dst_port"), lambda s: int(s * SECOND)
    risky = (F.col("risk") >= rules.suspicious).cast("int")
    out = df.withColumn("suspicious", prior_sum(risky, key, us(rules.window)) + risky)
    families = {
        "src_ip": {"src_flows": (None, rules.burst_window), "src_ports": ("dst_port", rules.scan_window), "src_hosts": ("dst_ip", rules.sweep_window), "src_ports_slow": ("dst_port", rules.slow_window)},
        "dst_ip": {"dst_flows": (None, rules.ddos_window), "dst_sources": ("src_ip", rules.ddos_window), "dst_ports": ("dst_port", rules.fanout_window)},
    }
    for by, measures in families.items():
        spans = {n: (column, us(span)) for n, (column, span) in measures.items()}
        hot = None if hot_rows is None else hot_keys(df, by, hot_rows)
        cut = spread(out, by, hot, max(span for _, span in spans.values()), slice_us)
        out = in_slices(cut, lambda by=by, spans=spans: Around(by, spans), ["seq"]).where("not context").drop("slice", "context")
        out = out.withColumns({n: F.col(n).cast("long") for n in spans})
    return out


def _triggers(rules: Rules) -> dict[str, tuple[str, str, str]]:
    """event type: (key, condition, count that is reported)."""
    on = lambda *t: " and ".join(f"{x} > 0" for x in t)
    known_dst = "dst_ip <> 'UNKNOWN'"
    speed = f"dst_ports / {float(rules.fanout_window)} >= {rules.fanout_velocity}" if rules.fanout_velocity > 0 else "true"
    return {
        "distributed_attack": ("dst_ip", f"{known_dst} and {on(rules.ddos_flows, rules.ddos_sources)} and dst_flows >= {rules.ddos_flows} and dst_sources >= {rules.ddos_sources}", "dst_flows"),
        "destination_port_fanout": ("dst_ip", f"{known_dst} and {on(rules.fanout_ports)} and dst_ports >= {rules.fanout_ports} and {speed}", "dst_ports"),
        "source_flow_burst": ("src_ip", f"{on(rules.burst_flows)} and src_flows >= {rules.burst_flows}", "src_flows"),
        "source_port_scan": ("src_ip", f"{on(rules.scan_ports)} and src_ports >= {rules.scan_ports}", "src_ports"),
        "source_dst_fanout": ("src_ip", f"{on(rules.sweep_hosts)} and src_hosts >= {rules.sweep_hosts}", "src_hosts"),
        "source_slow_scan": ("src_ip", f"{on(rules.slow_ports)} and src_ports_slow >= {rules.slow_ports}", "src_ports_slow"),
    }


def escalated(df: DataFrame, rules: Rules = Rules(), whole_batch: bool = False) -> DataFrame:
    """df (and decision) with context_decision and reasons.

    A pair that was suspicious often enough is HIGH at that row; a source or destination that crossed a threshold is HIGH from that row on, or, with
    whole_batch, in all its rows. Times are those of the events, so that old data are judged like new ones.
    """
    out = measured(df, rules)
    reasons = [F.when((F.col("suspicious") >= rules.least_events) & F.lit(rules.least_events > 0), F.lit("escalation"))]
    for name, (key, condition, _) in _triggers(rules).items():
        part = Window.partitionBy(key)
        frame = part if whole_batch else part.orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
        reasons.append(F.when(F.max(F.expr(condition).cast("int")).over(frame) == 1, F.lit(name)))
    out = out.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return out.withColumn("context_decision", F.when(F.size("reasons") > 0, "HIGH").otherwise(F.col("decision")))


def events(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """event_type, key, ts_us, seq, observed: every escalation of a pair whose decision it changes, and the first crossing of each threshold by each key."""
    rows = measured(df, rules)
    pair = F.concat_ws("|", "src_ip", "dst_ip", F.col("dst_port").cast("string"))
    own = (F.col("suspicious") >= rules.least_events) & F.col("decision").isin("LOW", "MEDIUM") & F.lit(rules.least_events > 0)
    found = [F.when(own, F.struct(F.lit("escalation").alias("event_type"), pair.alias("key"), F.col("suspicious").cast("long").alias("observed")))]
    for name, (key, condition, count) in _triggers(rules).items():
        found.append(F.when(F.expr(condition), F.struct(F.lit(name).alias("event_type"), F.col(key).alias("key"), F.col(count).cast("long").alias("observed"))))
    hits = rows.select("ts_us", "seq", F.explode(F.array_compact(F.array(*found))).alias("e")).select("e.event_type", "e.key", "ts_us", "seq", "e.observed")
    first = hits.where("event_type <> 'escalation'").groupBy("event_type", "key").agg(F.min(F.struct("ts_us", "seq", "observed")).alias("f"))
    return hits.where("event_type = 'escalation'").unionByName(first.select("event_type", "key", "f.ts_us", "f.seq", "f.observed"))


@dataclass(frozen=True)
class BlockLimits:
    ttl: float = 600
    most: int = 2000
    per_minute: int = 60


def candidates(df: DataFrame, resolution: float = 1.0) -> DataFrame:
    """src_ip, ts_us: the first row of each source in each step of time that asks for a block; a flood has one candidate a step."""
    rows = df.where("action = 'BLOCK' and src_ip is not null and trim(src_ip) not in ('', 'UNKNOWN')").select("src_ip", "ts_us")
    step = F.floor(F.col("ts_us") / F.lit(max(1, int(resolution * SECOND))))
    return rows.groupBy("src_ip", step.alias("step")).agg(F.min("ts_us").alias("ts_us")).select("src_ip", "ts_us")


def block_list(df: DataFrame, limits: BlockLimits = BlockLimits(), resolution: float = 1.0) -> DataFrame:
    """src_ip, blocked_us, ended_us, end (expired, evicted or in force) of every block, in the order of event time.

    A source that is in force is not blocked anew. A block ends after ttl; when the list is full the oldest goes; and a minute takes a limited
    number. Those limits hold for all sources together, so that one task decides them in one order, as a stream in bounded memory; what it
    reads are not the rows but their candidates, one for each source and step of time.
    """
    from weirflow.operators.blocking import fold

    few = candidates(df, resolution).repartition(1).sortWithinPartitions("ts_us", "src_ip")
    return few.mapInPandas(lambda batches: fold(batches, limits), "src_ip string, blocked_us long, ended_us long, end string")


def safe_blocks(df: DataFrame) -> DataFrame:
    """The blocks of public addresses."""
    from weirflow.functions.network import safe_to_block

    return df.where(safe_to_block(F.col("src_ip")))


def in_force(blocks: DataFrame, at_us: int) -> DataFrame:
    return blocks.where((F.col("blocked_us") <= at_us) & (F.coalesce("ended_us", F.lit((1 << 63) - 1)) > at_us))
