"""From scores to tiers and actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Thresholds:
    low: float = 0.30
    high: float = 0.60
    force_allow: float = 0.05
    alert: float = 0.40
    block: float = 0.70
    anomaly_block: float = 0.80
    hybrid_attack: float = 0.90
    hybrid_anomaly: float = -0.12
    second_stage: float = 0.70


def action(tier: Column) -> Column:
    return F.when(tier == "HIGH", "BLOCK").when(tier == "MEDIUM", "ALERT").otherwise("ALLOW")


def rank(tier: Column) -> Column:
    return F.when(tier == "HIGH", 3).when(tier == "MEDIUM", 2).otherwise(1)


def severest(a: Column, b: Column) -> Column:
    return F.when(rank(a) >= rank(b), a).otherwise(b)


def anomaly_sigmoid(raw: Column) -> Column:
    """0 to 1 from a raw score of which lower is more anomalous."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), -raw))))


def anomaly_spread(raw: Column, *batch: str) -> Column:
    """0 to 1 by the least and greatest raw score of a batch (all rows without one); 0 where they are equal."""
    every = Window.partitionBy(*batch)
    low, high = F.min(raw).over(every), F.max(raw).over(every)
    return F.when(high > low, (high - raw) / (high - low)).otherwise(0.0)


def risk(anomaly: Column, probability: Column, severity: Column | None = None, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> Column:
    severity = F.coalesce(severity, F.lit(0.0)) if severity is not None else F.lit(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), weights[0] * anomaly + weights[1] * probability + weights[2] * severity))


def tier(score: Column, low: float, high: float) -> Column:
    return F.when(score >= high, "HIGH").when(score >= low, "MEDIUM").otherwise("LOW")


def hybrid_label(probability: Column, raw: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(probability > t.hybrid_attack, "ATTACK").when(raw < t.hybrid_anomaly, "ANOMALY").otherwise("BENIGN")


def hybrid_tier(label: Column) -> Column:
    return F.when(label == "ATTACK", "HIGH").when(label == "ANOMALY", "MEDIUM").otherwise("LOW")


def primary_tier(probability: Column, anomaly: Column, t: Thresholds = Thresholds()) -> Column:
    """The tier by the first model, which a strong anomaly makes HIGH."""
    own = F.when(probability < t.force_allow, "LOW").when(probability >= t.block, "HIGH").when(probability >= t.alert, "MEDIUM").otherwise("LOW")
    return F.when(anomaly >= t.anomaly_block, "HIGH").otherwise(own)


def blended(anomaly: Column, probability: Column, severity: Column | None, raw: Column | None, first: Column | None, t: Thresholds = Thresholds(), block: float | None = 0.70) -> tuple[Column, Column]:
    """(risk, tier) by the weighted score: a high probability is HIGH, and with raw and first also the hybrid rule counts."""
    score = risk(anomaly, probability, severity)
    out = tier(score, t.low, t.high)
    if block is not None:
        score = F.when(probability >= block, F.greatest(score, F.lit(t.high))).otherwise(score)
        out = F.when(probability >= block, "HIGH").otherwise(out)
    if raw is not None and first is not None:
        out = severest(out, hybrid_tier(hybrid_label(first, raw, t)))
    return score, out


def assisted(model: Column, context: Column, full_authority: bool = False) -> Column:
    """The tier of model and context: context raises MEDIUM to HIGH, and decides alone with full authority."""
    return context if full_authority else F.when(model.isin("HIGH", "LOW"), model).otherwise(F.when(context == "HIGH", "HIGH").otherwise("MEDIUM"))


def capped(decision: Column, probability: Column, block: float = 0.70, full_authority: bool = False) -> Column:
    """HIGH falls to MEDIUM where the probability alone would not block."""
    return decision if full_authority else F.when((decision == "HIGH") & (probability < block - 1e-9), "MEDIUM").otherwise(decision)


def sample_weight(level: Column) -> Column:
    """Training weight of a weak label's risk level."""
    return F.when(level == "high", 0.0).when(level == "medium", 0.4).when(level == "low", 0.7).otherwise(1.0)
