"""Writers: each takes a DataFrame and a folder, and lets the tasks write their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import decisions, times

#: The columns of a label table, in their order.
GROUND_TRUTH = ("dataset_day", "timestamp", "event_type", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "flow_id", "flow_key", "http_method", "http_host", "http_url", "http_user_agent", "http_status", "label", "attack_type", "labeling_mode")


def in_order(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """names, in their order; empty where df has no such column."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit("")).alias(n) for n in names])


def split_tables(df: DataFrame, path: str, attack: Column) -> None:
    """Attack and benign rows in folders of their own, in one pass."""
    df.withColumn("part", F.when(attack, "attack").otherwise("benign")).write.mode("overwrite").option("header", True).partitionBy("part").csv(path)


def table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def capped_table(df: DataFrame, path: str, most: int) -> None:
    df.limit(most).write.mode("overwrite").parquet(path)


def decision_rows(df: DataFrame) -> DataFrame:
    """The log of decisions: ts_us, src_ip, dst_ip, dst_port, probability, risk, anomaly, decision and, if there, attack_type."""
    kind = [F.col("attack_type")] if "attack_type" in df.columns else []
    return df.select(
        times.iso_text(F.col("ts_us")).alias("timestamp"), "src_ip", "dst_ip", "dst_port", (F.col("decision") != "LOW").alias("is_attack"),
        F.round("probability", 6).alias("confidence"), F.round("risk", 6).alias("risk_score"), F.round("anomaly", 6).alias("anomaly_score_if"), decisions.action(F.col("decision")).alias("action"), *kind,
    )


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def weights(df: DataFrame) -> DataFrame:
    """flow_key, sample_weight, risk, rule of weakly labelled rows."""
    return df.select("flow_key", F.format_string("%.3f", decisions.sample_weight(F.col("tier"))).alias("sample_weight"), F.concat(F.lit("mawi_"), "tier").alias("risk"), "rule")


def original_lines(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """The events as they came (column value); with an order, parts are ranges of it and sorted within."""
    (df.orderBy(*order) if order else df).select("value").write.mode("overwrite").text(path)


def label_table(labels: DataFrame) -> DataFrame:
    """identity_key, label and, if there, subclass: labels as other programs read them, a row for each key."""
    more = [F.col("attack_subclass").alias("subclass")] if "attack_subclass" in labels.columns else []
    return labels.select("identity_key", F.col("binary_label").cast("int").alias("label"), *more)


def feature_cache(df: DataFrame, path: str) -> None:
    """A table of features for later runs."""
    df.write.mode("overwrite").parquet(path)


def cached_features(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """The features of a cache, all there and within their bounds; a cache that lacks one is an error."""
    from weirflow.operators.features import sane_all

    df = spark.read.parquet(path)
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"the cache lacks {', '.join(missing)}")
    return sane_all(df, names)
