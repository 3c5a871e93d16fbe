"""Smaller packs of window features, and rates that netflow records add to flows.

Windows are those of windows.py: the rows of a key before a row, or with the row itself where a pack says so. Counts and distinct counts
are running sums; only the variance of gaps takes a sweep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from weirflow.functions import network
from weirflow.functions.stats import entropy_of_counts
from weirflow.operators.joins import as_of
from weirflow.operators.sweep import MICRO, Gaps, Sweep
from weirflow.operators.windows import prior_distinct, swept, with_prior

SRC, DST = ("src_ip",), ("dst_ip",)
S10, S60, S120, S300 = 10 * MICRO, 60 * MICRO, 120 * MICRO, 300 * MICRO
#: The columns of each pack.
RECENT = (
    "src_ip_flow_count_60s", "dst_ip_flow_count_60s", "src_port_count_60s", "dst_port_count_60s", "service_freq_http", "service_freq_dns",
    "service_freq_ssh", "service_freq_other", "src_flow_count_120s", "failed_connection_ratio", "unique_dst_ips_60s", "dns_flow_ratio_per_src",
)
TEMPORAL = ("src_flow_count_10s", "src_to_dst_port_count_10s", "same_dst_port_ratio", "burst_ratio", "same_dst_ip_ratio")
BEHAVIOUR = (
    "src_flow_count_60s", "src_unique_dst_ports_60s", "src_unique_dst_ips_60s", "same_src_dst_port_count_60s", "dst_unique_src_120s",
    "is_internal_src", "is_internal_dst", "is_same_subnet", "tcp_flag_score",
)
TRACKERS = ("dst_port_variance_300s", "flow_iat_variance_300s", "dst_unique_src_ips_60s", "src_flow_count_300s", "tcp_flag_entropy_60s")


def _doubles(df: DataFrame, keep: Sequence[str], made: dict[str, Column]) -> DataFrame:
    return df.select(*keep, *[v.cast("double").alias(n) for n, v in made.items()])


def recent(flows: DataFrame) -> DataFrame:
    """flows with RECENT: counts of the last one and two minutes. The share of failed flows takes the row itself in."""
    failed = network.failed_connection(F.col("duration"), F.col("rev_bytes"), F.col("fwd_pkts"), F.col("rev_pkts"))
    kind = network.service(F.col("dst_port"), F.col("proto"))
    of = lambda name: (F.when(kind == name, 1).otherwise(0), SRC, S60)
    measures = {"p_src": (F.lit(1), SRC, S60), "p_src2": (F.lit(1), SRC, S120), "p_failed": (failed, SRC, S60)}
    measures |= {f"p_{n}": of(n) for n in ("http", "dns", "ssh", "other")} | {"p_dst": (F.lit(1), DST, S60)}
    out = with_prior(flows, measures)
    for name, value in (("p_sports", "src_port"), ("p_dports", "dst_port"), ("p_dsts", "dst_ip")):
        out = prior_distinct(out, name, value, SRC, S60)
    c, n = F.col, F.col("p_src")
    values = (
        n, c("p_dst"), c("p_sports"), c("p_dports"), c("p_http"), c("p_dns"), c("p_ssh"), c("p_other"), c("p_src2"),
        (c("p_failed") + failed) / (n + 1), c("p_dsts"), F.when(n > 0, c("p_dns") / n).otherwise(0.0),
    )
    return _doubles(out, flows.columns, dict(zip(RECENT, values)))


class GapSpread(Sweep):
    """The variance of the gaps between a source's rows of the last 300 seconds, in square seconds."""

    keys = SRC
    names = ("h_gap_variance",)

    def start(self) -> None:
        self.gaps = Gaps()

    def row(self, ts) -> tuple:
        while self.gaps.times and self.gaps.times[0] < ts - S300:
            self.gaps.remove()
        g = self.gaps
        out = ((g.n * g.q - g.s * g.s) / (g.n * g.n) / MICRO**2 if g.n >= 2 else 0.0,)
        g.add(ts)
        return out


def trackers(flows: DataFrame, flags: Sequence[Column] | None = None) -> DataFrame:
    """flows with TRACKERS: spread of ports and gaps, distinct sources of a destination, a count, and the entropy of six flags without an added eps.

    flags are 0/1 columns, by default the flow's own six.
    """
    port = F.col("dst_port")
    flags = flags if flags is not None else [F.col(n) for n in ("syn", "ack", "fin", "rst", "psh", "urg")]
    measures = {"p_n": (F.lit(1), SRC, S300), "p_x": (port, SRC, S300), "p_xx": (port * port, SRC, S300)}
    measures |= {f"p_flag{k}": (flag, SRC, S60) for k, flag in enumerate(flags)}
    out = prior_distinct(with_prior(flows, measures), "p_sources", "src_ip", DST, S60)
    out = swept(out, SRC, StructType([*out.schema.fields, StructField("h_gap_variance", DoubleType())]), GapSpread)
    n, x, xx = F.col("p_n"), F.col("p_x"), F.col("p_xx")
    spread = F.when(n >= 2, (n * xx - x * x) / (n * n)).otherwise(0.0)
    values = (spread, F.col("h_gap_variance"), F.col("p_sources"), n, entropy_of_counts(F.array(*[F.col(f"p_flag{k}") for k in range(len(flags))]), 0.0))
    return _doubles(out, flows.columns, dict(zip(TRACKERS, values)))


def temporal(flows: DataFrame) -> DataFrame:
    """flows with TEMPORAL: shares of a source's last 10 and 60 seconds, the row itself included."""
    service, pair = ("src_ip", "dst_ip", "dst_port"), ("src_ip", "dst_ip")
    out = with_prior(flows, {"p_10": (F.lit(1), SRC, S10), "p_60": (F.lit(1), SRC, S60), "p_s10": (F.lit(1), service, S10), "p_s60": (F.lit(1), service, S60), "p_d60": (F.lit(1), pair, S60)})
    up = lambda name: F.col(name) + 1
    values = (up("p_10"), up("p_s10"), up("p_s60") / up("p_60"), up("p_10") / up("p_60"), up("p_d60") / up("p_60"))
    return _doubles(out, flows.columns, dict(zip(TEMPORAL, values)))


def distinct_with_self(df: DataFrame, name: str, value: str, keys: Sequence[str], span_us: int) -> DataFrame:
    """df with the number of distinct values in the window of each row, its own included.

    That is one more than before it, unless its value is there already: its last row of that value is inside the span.
    """
    out = prior_distinct(df, name, value, keys, span_us)
    last = F.max("ts_us").over(Window.partitionBy(*keys, value).orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn(name, F.col(name) + F.when(F.coalesce(last >= F.col("ts_us") - span_us, F.lit(False)), 0).otherwise(1))


def behaviour(flows: DataFrame) -> DataFrame:
    """flows with BEHAVIOUR: counts of the last one and two minutes, the row itself included, and facts of its addresses and flags."""
    out = with_prior(flows, {"p_60": (F.lit(1), SRC, S60), "p_port": (F.lit(1), ("src_ip", "dst_port"), S60)})
    out = distinct_with_self(out, "p_ports", "dst_port", SRC, S60)
    out = distinct_with_self(out, "p_dsts", "dst_ip", SRC, S60)
    out = distinct_with_self(out, "p_sources", "src_ip", DST, S120)
    c, on = F.col, lambda name: F.col(name) > 0
    values = (
        c("p_60") + 1, c("p_ports"), c("p_dsts"), c("p_port") + 1, c("p_sources"), network.private_address(c("src_ip")).cast("int"), network.private_address(c("dst_ip")).cast("int"),
        network.same_prefix(c("src_ip"), c("dst_ip")).cast("int"), network.flag_score(on("syn"), on("ack"), on("fin"), on("rst")),
    )
    return _doubles(out, flows.columns, dict(zip(BEHAVIOUR, values)))


#: What a netflow record can say of a flow's pace.
PACE = ("pkt_rate", "byte_rate", "iat_min", "iat_max", "iat_avg")


def enriched(flows: DataFrame, records: DataFrame, ttl_us: int = S120) -> DataFrame:
    """flows (flow_key, ts_us, seq) with PACE: what the latest netflow record of their key says, if it is not older than ttl; else their own measure.

    records is sources.eve.netflow_metrics(). A record replaces those before it as a whole: what it does not say is the flow's own measure, not an older record's.
    """
    own = network.rhythms(F.col("duration"), F.col("fwd_bytes"), F.col("rev_bytes"), F.col("fwd_pkts"), F.col("rev_pkts"), F.lit(0), F.lit(0))
    told = [f"told_{n}" for n in PACE]
    out = as_of(flows, records.select("flow_key", "ts_us", "seq", *[F.col(n).alias(t) for n, t in zip(PACE, told)]), ["flow_key"], told, ttl_us)
    return out.select(*flows.columns, *[F.coalesce(t, own[n].cast("double")).alias(n) for n, t in zip(PACE, told)])
