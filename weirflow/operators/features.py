"""The 45 behavioural features of a flow from the flows before it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weirflow.functions.stats import EPS, entropy_of_counts
from weirflow.operators.sweep import MICRO, ByDestination, BySource, Sweep
from weirflow.operators.windows import hot_keys, spread, swept, with_prior

#: The features in their order, each with its upper bound (None: none). Their lower bound is 0, that of AUTOCORRELATION -1.
AUTOCORRELATION = "iat_autocorr_srcdst_300s"
FEATURES: tuple[tuple[str, float | None], ...] = (
    ("flow_rate_src_10s", None),
    ("flow_rate_src_60s", None),
    ("flow_rate_dst_10s", None),
    ("rate_ratio_src_10s_60s", None),
    ("rate_ratio_src_60s_300s", None),
    ("concurrent_flows_src_10s", None),
    ("concurrent_flows_dst_10s", None),
    ("concurrent_flows_per_dst_port_10s", None),
    ("unique_src_ips_by_dst_60s", None),
    ("dst_ip_unique_src_ips_10s", None),
    ("new_dst_ip_ratio_src_300s", 1.0),
    ("new_dst_port_ratio_src_300s", 1.0),
    ("new_dst_ips_per_sec", None),
    ("new_dst_ports_per_sec", None),
    ("dst_ip_entropy_src_300s", None),
    ("dst_port_entropy_src_300s", None),
    ("iat_cv_src_60s", None),
    ("iat_cv_srcdst_300s", None),
    (AUTOCORRELATION, 1.0),
    ("bytes_ratio_fwd_rev", None),
    ("short_flow_ratio_src_300s", 1.0),
    ("avg_bytes_per_flow_src_300s", None),
    ("bytes_per_flow_srcdst", None),
    ("connection_reuse_ratio_srcdst", 1.0),
    ("flow_size_mode_src_300s", None),
    ("retry_rate_same_dstport_300s", 1.0),
    ("retry_rate_same_dstip_300s", 1.0),
    ("dst_port_reuse_ratio_src_300s", 1.0),
    ("syn_heavy_ratio_src_60s", 1.0),
    ("syn_to_established_ratio", None),
    ("rst_ratio_src_60s", 1.0),
    ("rst_to_syn_ratio_src_60s", None),
    ("tcp_flag_entropy_src_60s", None),
    ("ack_presence_ratio", 1.0),
    ("small_response_ratio_src_60s", 1.0),
    ("incomplete_flow_duration_ratio_src_300s", 1.0),
    ("low_data_rate_long_flow_ratio_src_300s", 1.0),
    ("src_contribution_to_dst_ratio_60s", 1.0),
    ("rst_micro_flow_ratio_src_60s", 1.0),
    ("single_dst_port_focus_src_60s", 1.0),
    ("rst_after_ack_ratio_src_60s", 1.0),
    ("dst_src_ip_entropy_60s", None),
    ("avg_flow_per_src_to_dst_10s", None),
    ("iat_regularity_src_60s", None),
    ("has_tcp", 1.0),
)
NAMES = tuple(n for n, _ in FEATURES)
DAY = 86_400 * MICRO


#: Flows of one time are processed in this order.
TURN = ("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "seq")


def _turn(df: DataFrame) -> list[str]:
    return [c for c in TURN if c in df.columns]


def in_slices(df: DataFrame, make: Callable[[], Sweep], turn: Sequence[str]) -> DataFrame:
    """df (with slice, see windows.spread) with the features of a sweep over each key and slice."""
    sample = make()
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in sample.names]])

    def sliced() -> Sweep:
        sweep = make()
        sweep.keys = (*sweep.keys, "slice")
        return sweep

    return swept(df, (*sample.keys, "slice"), schema, sliced, seq=turn)


def _swept(df: DataFrame, sweep: type[Sweep]) -> DataFrame:
    return in_slices(df, sweep, _turn(df))


def sane(value: Column, name: str, high: float | None) -> Column:
    """value with what is missing or not finite as 0, within the feature's bounds."""
    number = value.try_cast("double")
    fine = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    number = F.when(fine, number).otherwise(0.0)
    number = F.greatest(number, F.lit(-1.0 if name == AUTOCORRELATION else 0.0))
    return F.least(number, F.lit(high)) if high is not None else number


def sane_all(df: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """df with all features that it has within their bounds."""
    bounds = dict(FEATURES)
    return df.withColumns({n: sane(F.col(n), n, bounds[n]) for n in names if n in df.columns})


def by_source(flows: DataFrame, hot: DataFrame | None = None, slice_us: int = 3600 * MICRO) -> DataFrame:
    """flows with the measures of their source and pair: running sums, and a sweep for what needs a window's histogram or gaps.

    All share the shuffle by source (and slice). With hot (sources), their rows are cut into slices of time: of a day for the sums over a day,
    and of slice_us for all others.
    """
    one, flag = F.lit(1), lambda c: F.when(c, 1).otherwise(0)
    src, pair = ("src_ip", "slice"), ("src_ip", "dst_ip", "slice")
    s10, s60, s300 = 10 * MICRO, 60 * MICRO, 300 * MICRO
    dur, fwd, rev, total = (F.col(c) for c in ("duration", "fwd_bytes", "rev_bytes", "total_bytes"))
    micro = (F.col("rst") > 0) & (dur <= 0.5) & (total <= 150) & (fwd <= 120) & (rev <= 120)
    slow = (dur > 120) & (total / (dur + EPS) < 64)
    day = {"n_s24": (one, src, DAY), "n_p24": (one, pair, DAY), "bytes_p24": (total, pair, DAY)}
    short = {
        "n_s10": (one, src, s10),
        "n_s60": (one, src, s60),
        "n_s300": (one, src, s300),
        "syn_60": (F.col("syn"), src, s60),
        "ack_60": (F.col("ack"), src, s60),
        "rst_60": (F.col("rst"), src, s60),
        "fin_60": (F.col("fin"), src, s60),
        "pkts_60": (F.col("tcp_pkts"), src, s60),
        "ack_300": (flag(F.col("ack") > 0), src, s300),
        "short_300": (flag(dur < 1), src, s300),
        "slow_300": (flag(slow), src, s300),
        "bytes_300": (total, src, s300),
        "small_60": (flag((rev < 128) & (fwd > 256)), src, s60),
        "micro_60": (flag(micro), src, s60),
        "rst_ack_60": (flag((F.col("ack") > 0) & (F.col("rst") > 0)), src, s60),
        "n_p60": (one, pair, s60),
    }
    out, turn = flows, _turn(flows)
    if hot is not None:  # a slice for each span
        out = with_prior(spread(out, "src_ip", hot, DAY, DAY), day, seq=turn).where("not context").drop("slice", "context")
        day = {}
    out = spread(out, "src_ip", hot, s300, slice_us).repartition("src_ip", "slice")
    out = with_prior(out, day | short, seq=turn)
    return _swept(out, BySource).where("not context").drop("slice", "context")


def by_destination(flows: DataFrame, hot: DataFrame | None = None, slice_us: int = 3600 * MICRO) -> DataFrame:
    """flows with the measures of their destination, as by_source()."""
    dst, s60 = ("dst_ip", "slice"), 60 * MICRO
    out = spread(flows, "dst_ip", hot, s60, slice_us).repartition("dst_ip", "slice")
    out = with_prior(out, {"n_d10": (F.lit(1), dst, 10 * MICRO), "n_d60": (F.lit(1), dst, s60)}, seq=_turn(flows))
    return _swept(out, ByDestination).where("not context").drop("slice", "context")


def measured(flows: DataFrame, hot_rows: int | None = None, slice_us: int = 3600 * MICRO) -> DataFrame:
    """flows with all that the features are made of."""
    hot = lambda key: None if hot_rows is None else hot_keys(flows, key, hot_rows)
    return by_destination(by_source(flows, hot("src_ip"), slice_us), hot("dst_ip"), slice_us)


def features(flows: DataFrame, hot_rows: int | None = None, slice_us: int = 3600 * MICRO) -> DataFrame:
    """flows (see sources.eve.to_flows) with the 45 features, within their bounds.

    Flows of one time are taken in the order of TURN. With hot_rows, sources and destinations with more rows than that are cut into slices of time,
    so that one scanner is no single task; their rows are counted first, so that flows should then be a table.
    """
    df = measured(flows, hot_rows, slice_us)
    c = F.col
    n60, n300 = c("n_s60"), c("n_s300")
    share = lambda a, b: a / (b + EPS)
    enough = lambda value: F.when(n60 >= 5, value).otherwise(0.0)
    several = lambda value: F.when(n300 > 1, value).otherwise(0.0)
    rate10, rate60 = c("n_s10") / 10, n60 / 60
    cv = c("h_iat_cv_60")
    made = {
        "flow_rate_src_10s": rate10,
        "flow_rate_src_60s": rate60,
        "flow_rate_dst_10s": c("n_d10") / 10,
        "rate_ratio_src_10s_60s": share(rate10, rate60),
        "rate_ratio_src_60s_300s": share(rate60, n300 / 300),
        "concurrent_flows_src_10s": c("h_active_src"),
        "concurrent_flows_dst_10s": c("h_active_dst"),
        "concurrent_flows_per_dst_port_10s": c("h_active_service"),
        "unique_src_ips_by_dst_60s": c("h_src_distinct_60"),
        "dst_ip_unique_src_ips_10s": c("h_src_distinct_10"),
        "new_dst_ip_ratio_src_300s": several(c("h_dst_distinct") / F.nullif(n300, F.lit(0))),
        "new_dst_port_ratio_src_300s": several(c("h_dport_distinct") / F.nullif(n300, F.lit(0))),
        "new_dst_ips_per_sec": several(c("h_dst_distinct") / 300),
        "new_dst_ports_per_sec": several(c("h_dport_distinct") / 300),
        "dst_ip_entropy_src_300s": c("h_dst_entropy"),
        "dst_port_entropy_src_300s": c("h_dport_entropy"),
        "iat_cv_src_60s": cv,
        "iat_cv_srcdst_300s": c("h_pair_iat_cv"),
        AUTOCORRELATION: c("h_pair_autocorr"),
        "bytes_ratio_fwd_rev": c("fwd_bytes") / (c("rev_bytes") + 1),
        "short_flow_ratio_src_300s": share(c("short_300"), n300),
        "avg_bytes_per_flow_src_300s": share(c("bytes_300"), n300),
        "bytes_per_flow_srcdst": share(c("bytes_p24"), c("n_p24")),
        "connection_reuse_ratio_srcdst": share(c("n_p24"), c("n_s24")),
        "flow_size_mode_src_300s": c("h_mode"),
        "retry_rate_same_dstport_300s": share(n300 - c("h_pair_distinct"), n300),
        "retry_rate_same_dstip_300s": share(n300 - c("h_dst_distinct"), n300),
        "dst_port_reuse_ratio_src_300s": share(c("h_dport_most"), n300),
        "syn_heavy_ratio_src_60s": share(c("syn_60"), c("pkts_60")),
        "syn_to_established_ratio": share(c("syn_60"), c("ack_60")),
        "rst_ratio_src_60s": share(c("rst_60"), n60),
        "rst_to_syn_ratio_src_60s": share(c("rst_60"), c("syn_60")),
        "tcp_flag_entropy_src_60s": entropy_of_counts(F.array("syn_60", "ack_60", "rst_60", "fin_60")),
        "ack_presence_ratio": share(c("ack_300"), n300),
        "small_response_ratio_src_60s": F.when(n60 > 0, c("small_60") / n60).otherwise(0.0),
        "incomplete_flow_duration_ratio_src_300s": share(c("short_300"), n300),
        "low_data_rate_long_flow_ratio_src_300s": share(c("slow_300"), n300),
        "src_contribution_to_dst_ratio_60s": share(c("n_p60"), c("n_d60")),
        "rst_micro_flow_ratio_src_60s": enough(share(c("micro_60"), n60)),
        "single_dst_port_focus_src_60s": enough(share(c("h_dport_most_60"), n60)),
        "rst_after_ack_ratio_src_60s": F.when(c("has_tcp") > 0, enough(share(c("rst_ack_60"), n60))).otherwise(0.0),
        "dst_src_ip_entropy_60s": c("h_src_entropy_60"),
        "avg_flow_per_src_to_dst_10s": share(c("n_d10"), c("h_src_distinct_10")),
        "iat_regularity_src_60s": enough(F.when(cv > 0, 1 / (cv + EPS)).otherwise(0.0)),
        "has_tcp": c("has_tcp").cast("double"),
    }
    keep = [F.col(x) for x in flows.columns if x != "has_tcp"]
    bounds = dict(FEATURES)
    return df.select(*keep, *[sane(made[n], n, bounds[n]).alias(n) for n in NAMES])

