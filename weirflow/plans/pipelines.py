"""Whole plans: labelled training tables, scored events, label tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import decisions
from weirflow.functions.decisions import Thresholds
from weirflow.operators import context, features, joins
from weirflow.operators.context import Rules
from weirflow.sources import eve


@dataclass(frozen=True)
class FlowOptions:
    dedupe: bool = False
    benign_only: bool = False
    need_flow: bool = True
    bucket_seconds: float = 5.0
    #: Rows of a source or destination beyond which it is cut into slices of time; events should then be a table.
    hot_rows: int | None = None


@dataclass(frozen=True)
class ScoreOptions:
    thresholds: Thresholds = field(default_factory=Thresholds)
    rules: Rules | None = None
    whole_batch: bool = False
    context_can_block: bool = False


def session(name: str = "weirflow", **conf: str) -> SparkSession:
    """A session with what the plans rely on: UTC, adaptive execution with skew handling, Arrow."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def flow_features(events: DataFrame, options: FlowOptions = FlowOptions()) -> DataFrame:
    """Flows of events with the 45 features."""
    flows = eve.to_flows(events, options.dedupe, options.benign_only, options.need_flow, options.bucket_seconds)
    return features.features(flows, options.hot_rows)


def reachable(flows: DataFrame, labels: DataFrame, key: str = "identity_key") -> DataFrame:
    """The flows that can matter to a labelled one: those that share its source or its destination, as every window is by one of them."""
    wanted = flows.join(labels.select(key).distinct(), key, "left_semi")
    by = lambda c: flows.join(wanted.select(c).distinct(), c, "left_semi")
    return by("src_ip").unionByName(by("dst_ip").join(wanted.select("src_ip").distinct(), "src_ip", "left_anti"))


def training_table(events: DataFrame, labels: DataFrame, options: FlowOptions = FlowOptions(), subclass: bool = True, few_labels: bool = False) -> DataFrame:
    """The 45 features of labelled flows with binary_label (and attack_subclass), identity_key and flow_key.

    Windows see all flows that they reach; labels select rows only after that. With few_labels, flows that no labelled one can reach are left
    out before the windows, which pays when most sources have no label; events should then be a table, as they are read several times.
    """
    flows = eve.to_flows(events, options.dedupe, options.benign_only, options.need_flow, options.bucket_seconds)
    made = features.features(reachable(flows, labels) if few_labels else flows, options.hot_rows)
    keep = [*features.NAMES, "identity_key", "flow_key"]
    out = joins.labelled(made.select(*keep), labels, "identity_key")
    return out.select(*features.NAMES, "binary_label", *(["attack_subclass"] if subclass else []), "identity_key", "flow_key")


def decided(df: DataFrame, options: ScoreOptions = ScoreOptions()) -> DataFrame:
    """df (probability, anomaly; for context also seq, ts_us, src_ip, dst_ip, dst_port) with risk, decision and action."""
    t = options.thresholds
    out = df.withColumn("risk", F.col("probability")).withColumn("decision", decisions.primary_tier(F.col("probability"), F.col("anomaly"), t))
    if options.rules is not None:
        out = context.escalated(out, options.rules, options.whole_batch)
        merged = decisions.assisted(F.col("decision"), F.col("context_decision"), options.context_can_block)
        out = out.withColumn("decision", decisions.capped(merged, F.col("probability"), t.block, options.context_can_block))
    return out.withColumn("action", decisions.action(F.col("decision")))


def ground_truth(rows: DataFrame, day: Column) -> DataFrame:
    """Labelled flow and request rows in the columns of a label table."""
    from weirflow.functions import times
    from weirflow.operators.labeling import truth_key
    from weirflow.sources.sinks import GROUND_TRUTH, in_order

    key = truth_key(day, F.col("flow_id"), F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("proto"), F.col("ts_us"))
    out = rows.withColumn("dataset_day", day).withColumn("flow_key", key).withColumn("timestamp", times.iso_text(F.col("ts_us")))
    return in_order(out.withColumn("flow_id", F.coalesce("flow_id", F.lit(""))), GROUND_TRUTH)
