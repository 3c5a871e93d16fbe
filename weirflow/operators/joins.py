"""Joins of events with labels, schedules and indicators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a counted dimension table is broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast only if a count says that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def last_wins(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last row of each key: an aggregate, so that a key with very many rows is combined before the shuffle."""
    rest = [c for c in df.columns if c not in (key,)]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def labelled(features: DataFrame, labels: DataFrame, key: str = "identity_key", seq: str = "seq") -> DataFrame:
    """features with the label of their key; those without one are left out, of several labels the last holds."""
    chosen = last_wins(labels.where(F.col(key).isNotNull()), key, seq).drop(seq)
    return features.join(chosen, key, "inner")


def coverage(features: DataFrame, labels: DataFrame, key: str = "identity_key") -> DataFrame:
    """matched, label_keys, ratio: how many of the labels' keys the features meet."""
    keys = labels.select(key).where(F.col(key).isNotNull()).distinct()
    met = keys.join(features.select(key).distinct().withColumn("_met", F.lit(1)), key, "left")
    out = met.agg(F.count("_met").alias("matched"), F.count(F.lit(1)).alias("label_keys"))
    return out.withColumn("ratio", F.coalesce(F.try_divide("matched", "label_keys"), F.lit(0.0)))


def unmatched(features: DataFrame, labels: DataFrame, key: str = "identity_key", most: int = 100) -> DataFrame:
    """At most so many of the features' keys that no label has, the least first."""
    return features.select(key).distinct().join(labels.select(key), key, "left_anti").orderBy(key).limit(most)


def overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """shared, only_train, only_test: distinct keys of two splits, in one aggregate."""
    both = train.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(test.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    sides = both.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return sides.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("shared"), F.count_if(F.col("b") == 0).alias("only_train"), F.count_if(F.col("a") == 0).alias("only_test"))


def scheduled(events: DataFrame, schedule: DataFrame, matches: Callable[[Column], Column], order: str, keep: Sequence[str], prefix: str = "") -> DataFrame:
    """events with the first row of a schedule, by order, that matches(row) accepts; keep names the schedule's columns that are added (null without a match).

    A schedule has tens of rows: they travel as one array in one broadcast row, which each event searches in place, so that no event is
    multiplied and none has to be folded again.
    """
    rows = schedule.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), *[c for c in schedule.columns if c != order]))).alias("_rows"))
    wide = events.crossJoin(F.broadcast(rows))  # one row
    return wide.withColumn("_hit", F.get(F.filter("_rows", matches), F.lit(0))).select(*events.columns, *[F.col(f"_hit.{c}").alias(f"{prefix}{c}") for c in keep])


def as_of(events: DataFrame, facts: DataFrame, keys: Sequence[str], keep: Sequence[str], ttl_us: int | None = None, ts: str = "ts_us", seq: str = "seq") -> DataFrame:
    """events with the latest fact of their keys at or before them, null beyond ttl.

    Both sides are put on one line of time for each key and the last fact is carried along it, so that the cost is a sort and not a range join.
    """
    facts = facts.select(*keys, F.col(ts), F.struct(F.col(ts).alias("_at"), *keep).alias("_fact"), F.lit(0).alias("_side"), F.col(seq).alias(seq))
    rows = events.withColumn("_fact", F.lit(None).cast(facts.schema["_fact"].dataType)).withColumn("_side", F.lit(1))
    line = Window.partitionBy(*keys).orderBy(ts, "_side", seq).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(facts, allowMissingColumns=True).withColumn("_last", F.last("_fact", ignorenulls=True).over(line)).where("_side = 1")
    fresh = F.lit(True) if ttl_us is None else F.col(ts) - F.col("_last._at") <= ttl_us
    return both.select(*events.columns, *[F.when(fresh, F.col(f"_last.{c}")).alias(c) for c in keep])


def within(events: DataFrame, facts: DataFrame, keys: Sequence[str], tolerance_us: int, ts: str = "ts_us", seq: str = "seq") -> DataFrame:
    """events with matched: whether a fact of the same keys is at most tolerance away in time.

    Only the nearest fact on either side can tell, and both come from one pass over each key's line of time.
    """
    rows = events.withColumn("_side", F.lit(1)).unionByName(facts.select(*keys, ts).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    fact = F.when(F.col("_side") == 0, F.col(ts))
    part = Window.partitionBy(*keys).orderBy(ts)
    before = F.max(fact).over(part.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(fact).over(part.rangeBetween(0, Window.unboundedFollowing))
    near = F.least(F.col(ts) - before, after - F.col(ts)) <= tolerance_us
    return rows.withColumn("matched", F.coalesce(near, F.lit(False))).where("_side = 1").select(*events.columns, "matched")


def restored(events: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The events whose key is among keys, as they are."""
    return events.join(keys.select(key).distinct(), key, "left_semi")


def not_chosen(rows: DataFrame, chosen: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys were not chosen; null keys are equal to null."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
    return rows.alias("r").join(chosen.select(*keys).distinct().alias("c"), condition, "left_anti")


def tiered(events: DataFrame, indicators: DataFrame, rules: Sequence[tuple[str, str, str, tuple[str, ...]]], facts: dict[str, Column], default: tuple[str, str] = ("normal", "none")) -> DataFrame:
    """events with tier and rule: the first of rules (tier, rule, kind, facts) of which one of the facts is an indicator of that kind.

    indicators has kind and value. Each fact is looked up once: kinds of a value are gathered in a set, and a fact's kinds are joined to it.
    """
    sets = small(indicators.groupBy("value").agg(F.sort_array(F.collect_set("kind")).alias("kinds")))
    out, columns = events, {}
    for name, value in facts.items():
        columns[name] = f"_kinds_{name}"
        out = out.withColumn("_value", value).join(sets.select(F.col("value").alias("_value"), F.col("kinds").alias(columns[name])), "_value", "left").drop("_value")
    tier, rule = F.lit(default[0]), F.lit(default[1])
    for t, r, kind, names in reversed(rules):
        hit = F.lit(False)
        for n in names:
            hit = hit | F.coalesce(F.array_contains(columns[n], kind), F.lit(False))
        tier, rule = F.when(hit, t).otherwise(tier), F.when(hit, r).otherwise(rule)
    return out.withColumn("tier", tier).withColumn("rule", rule).drop(*columns.values())
