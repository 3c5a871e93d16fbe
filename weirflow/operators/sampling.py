"""Orders, limits, quotas and samples. What is drawn depends on a seeded hash of the rows' keys, never on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.functions import network
from weirflow.operators.joins import small


def draw(seed: int, *keys: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def in_time_order(df: DataFrame, ts: Column, offset: str) -> DataFrame:
    """df by time, rows without one last, equal times by offset: a range shuffle and a spilling sort."""
    return df.orderBy(ts.asc_nulls_last(), F.col(offset))


def is_in_order(df: DataFrame, ts: str, offset: str, span: int = 1 << 20) -> DataFrame:
    """in_order: whether no row is before an earlier one (rows without a time aside), told inside ranges of offset and from the bounds of those ranges."""
    part = F.floor(F.col(offset) / span)
    before = Window.partitionBy(part).orderBy(offset).rowsBetween(Window.unboundedPreceding, -1)
    steps = df.select(part.alias("part"), F.col(ts).alias("t"), F.max(ts).over(before).alias("high"))
    ends = steps.groupBy("part").agg(F.count_if(F.col("t") < F.col("high")).alias("bad"), F.min("t").alias("low"), F.max("t").alias("top"))
    edge = F.col("low") < F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    found = ends.withColumn("edge", F.coalesce(edge, F.lit(False)).cast("long"))
    return found.agg((F.coalesce(F.sum(F.col("bad") + F.col("edge")), F.lit(0)) == 0).alias("in_order"))


def ranges(df: DataFrame, n: int, ts: str, offset: str) -> DataFrame:
    """df with range (0 to n - 1), ranges of time of about equal size: quantiles first, then a lookup, so that no task sees all rows."""
    cuts = df.agg(F.approx_percentile(F.col(ts), F.array(*[F.lit(k / n) for k in range(1, n)]), 10_000).alias("cuts")) if n > 1 else df.limit(0).agg(F.array().cast("array<long>").alias("cuts"))
    over = F.size(F.filter("cuts", lambda c: c < F.col(ts)))
    return df.crossJoin(F.broadcast(cuts)).withColumn("range", F.coalesce(over, F.lit(0)).cast("int")).drop("cuts")


def running(df: DataFrame, order: str, value: str, parts: int = 64) -> DataFrame:
    """df with before: the sum of value over the rows with a smaller order, which is unique.

    The rows are cut into ranges by approximate quantiles; sums run inside a range, and those of the ranges before it come from a table of parts rows.
    """
    cut = ranges(df, parts, order, order).withColumnRenamed("range", "part")
    inside = F.sum(value).over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    whole = cut.groupBy("part").agg(F.sum(value).alias("whole"))
    ahead = whole.select("part", F.coalesce(F.sum("whole").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    out = cut.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(ahead), "part")  # parts rows
    return out.select(*df.columns, (F.col("inside") + F.col("ahead")).alias("before"))


def percentiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """cuts: the exact percentiles of a column, between neighbours by their distance, from running counts of its distinct values; null without rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, "x", "n").crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all"))))  # one row
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("x")))
    cells = []
    for k, share in enumerate(shares):
        place = F.lit(float(share)) * (F.col("all") - 1)
        cells += [at(F.floor(place)).alias(f"a{k}"), at(F.ceil(place)).alias(f"b{k}"), F.max(place - F.floor(place)).alias(f"w{k}")]
    row = ranked.agg(*cells)
    return row.select(F.array(*[(1 - F.col(f"w{k}")) * F.col(f"a{k}") + F.col(f"w{k}") * F.col(f"b{k}") for k in range(len(shares))]).alias("cuts"))


def line_range(df: DataFrame, first: int, last: int, ts: Column, offset: str) -> DataFrame:
    """Rows first to last (from 0, last left out) of the time order."""
    return in_time_order(df, ts, offset).offset(first).limit(last - first)


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    return df.orderBy(draw(seed, *keys), *keys)


def sample(df: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """k rows by the least hashes of their keys: each task passes on k rows at most."""
    return df.orderBy(draw(seed, *keys), *keys).limit(k)


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def largest_remainder(weights: DataFrame, total: Column, part: str, weight: str, within: Sequence[str] = ()) -> DataFrame:
    """weights with quota: total shared by weight, the floors first and what is left by the largest fractions (ties by part).

    within: columns whose groups are shared out each; total may be one of weights' columns.
    """
    group = Window.partitionBy(*within)
    whole = F.sum(weight).over(group)
    raw = F.coalesce(F.try_divide(F.col(weight).cast("double") * total, whole), F.lit(0.0))
    out = weights.withColumn("_base", F.floor(raw)).withColumn("_frac", raw - F.floor(raw)).withColumn("_total", total.cast("long"))
    out = out.withColumn("_left", F.col("_total") - F.sum("_base").over(group))
    place = F.row_number().over(group.orderBy(F.col("_frac").desc(), part))
    more = F.when((place <= F.col("_left")) & (F.col(weight) > 0), 1).otherwise(0)
    return out.withColumn("quota", (F.col("_base") + more).cast("long")).drop("_base", "_frac", "_total", "_left")


def nested_quotas(sizes: DataFrame, total: int, outer: str, inner: str, size: str = "n") -> DataFrame:
    """outer, inner, n, quota: total shared by the outer groups' sizes, and each share by the inner ones'."""
    outers = largest_remainder(sizes.groupBy(outer).agg(F.sum(size).alias("w")), F.lit(total), outer, "w").select(outer, F.col("quota").alias("_share"))
    return largest_remainder(sizes.join(outers, outer), F.col("_share"), inner, size, [outer]).drop("_share")


def capped_quotas(quotas: DataFrame, total: int, order: Sequence[str], quota: str = "quota", available: str = "available") -> DataFrame:
    """quotas clipped to what is available; what is then missing to total goes, row by row, to whoever has most to spare (ties by order).

    That levels the spare amounts from above. The level is found from running sums over the sorted spares, without a loop.
    """
    out = quotas.withColumn("_q", F.least(quota, available)).withColumn("_spare", F.col(available) - F.col("_q"))
    every = Window.partitionBy()
    out = out.withColumn("_need", F.greatest(F.lit(0), F.lit(total) - F.sum("_q").over(every)))
    down = Window.orderBy(F.col("_spare").desc(), *order)
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_k", F.row_number().over(down)).withColumn("_sum", F.sum("_spare").over(upto))
    # With the k largest spares levelled to x, sum - k * x rows are given: the level for each k, of which the largest that is not above its own spares holds.
    level = F.greatest(F.lit(0), F.ceil((F.col("_sum") - F.col("_need")) / F.col("_k")))
    next_spare = F.coalesce(F.lead("_spare").over(down), F.lit(0))
    fits = (level <= F.col("_spare")) & (level >= next_spare)
    out = out.withColumn("_level", F.max(F.when(fits, level)).over(every)).withColumn("_level", F.coalesce("_level", F.lit(0)))
    out = out.withColumn("_give", F.when(F.col("_need") > 0, F.greatest(F.lit(0), F.col("_spare") - F.col("_level"))).otherwise(0))
    out = out.withColumn("_short", F.col("_need") - F.sum("_give").over(every))
    # A level is a whole number: of the spares at it, the first ones give one more.
    at = (F.col("_spare") - F.col("_give") == F.col("_level")) & (F.col("_level") > 0)
    place = F.row_number().over(Window.partitionBy(at).orderBy(*order))
    return out.withColumn("quota", (F.col("_q") + F.col("_give") + F.when(at & (place <= F.col("_short")), 1).otherwise(0)).cast("long")).drop("_q", "_spare", "_need", "_k", "_sum", "_level", "_give", "_short")


def quota_sample(df: DataFrame, quotas: DataFrame, strata: Sequence[str], seed: int, *keys: str) -> DataFrame:
    """For each stratum its quota of rows, by the least hashes of their keys."""
    place = Window.partitionBy(*strata).orderBy(draw(seed, *keys), *keys)
    condition = F.lit(True)
    for s in strata:
        condition = condition & F.col(f"d.{s}").eqNullSafe(F.col(f"q.{s}"))
    joined = df.alias("d").join(small(quotas.select(*strata, "quota")).alias("q"), condition).select("d.*", F.col("q.quota").alias("_quota"))
    return joined.withColumn("_n", F.row_number().over(place)).where("_n <= _quota").drop("_n", "_quota")


def trimmed(df: DataFrame, most: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(most)


def relative_caps(df: DataFrame, label: str, targets: dict[str, int], factor: float | None, ignored: Sequence[str] = ()) -> dict[str, int]:
    """targets, none above factor times the largest class that is neither a target nor ignored (if there is one)."""
    if not factor or factor <= 0:
        return dict(targets)
    name = F.lower(F.col(label).cast("string"))
    others = df.where(~name.isin(*targets, *[x.lower() for x in ignored])).groupBy(name.alias("l")).agg(F.count(F.lit(1)).alias("n"))
    most = others.agg(F.max("n")).first()[0]
    if not most:
        return dict(targets)
    ceiling = max(1, -(-int(most * factor * 1e9) // 10**9))
    return {k: min(v, ceiling) for k, v in targets.items()}


def with_phase(df: DataFrame, ts_us: str, phases: int, by: Sequence[str] = ()) -> DataFrame:
    """df with phase: equal parts of each group's span of time."""
    group = Window.partitionBy(*by)
    low, high = F.min(ts_us).over(group), F.max(ts_us).over(group)
    at = F.least(F.lit(phases - 1), F.floor((F.col(ts_us) - low) / F.nullif(high - low, F.lit(0)) * phases))
    return df.withColumn("phase", F.when(F.col(ts_us).isNull(), "phase_unknown").otherwise(F.concat(F.lit("phase_"), F.coalesce(at, F.lit(0)).cast("int").cast("string"))))


def downsampled(
    df: DataFrame, label: str, targets: dict[str, int], key: str, ts_us: str = "ts_us", source: str = "src_ip", port: str = "dst_port", duration: str = "duration", event_type: str | None = None,
    bucket_seconds: int = 60, per_source: int = 500, least: int = 10, phases: int = 1, extra: Sequence[str] = (), seed: int = 42, unique: str | None = None,
) -> DataFrame:
    """df with the classes in targets (names in lower case) cut down to so many rows; others stay whole.

    A class's target is shared by the sizes of its strata (time, kind, port range, length and extra columns). In a stratum a source gives per_source
    rows at most, and the stratum its share but at least `least`. What is then too much is cut, and what is missing is drawn from
    the rest of the class. Draws are by hash, so that the result is the same in any run; with unique, rows that repeat that column go.
    """
    name = F.lower(F.col(label).cast("string"))
    rows = df.withColumn("_class", name)
    wanted = F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, v)])
    rows = rows.withColumn("_target", F.try_element_at(wanted, F.col("_class")))
    rows = with_phase(rows, ts_us, phases, ["_class"]).withColumnRenamed("phase", "_phase") if phases > 1 else rows.withColumn("_phase", F.lit(""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    stratum = F.xxhash64(F.coalesce(F.floor(F.col(ts_us) / (bucket_seconds * 1_000_000)).cast("string"), F.lit("t_unknown")), "_phase", text(event_type) if event_type else F.lit(""), network.port_bucket(F.col(port)), network.duration_bucket(F.col(duration)), *[text(c) for c in extra])
    rows = rows.withColumn("_stratum", stratum).withColumn("_draw", draw(seed, key))
    part = rows.where(F.col("_target").isNotNull())
    sizes = part.groupBy("_class", "_stratum").agg(F.count(F.lit(1)).alias("_n"), F.first("_target").alias("_target"))
    quotas = largest_remainder(sizes, F.col("_target"), "_stratum", "_n", ["_class"]).withColumn("_size", F.sum("_n").over(Window.partitionBy("_class")))
    part = part.drop("_target").join(quotas.select("_class", "_stratum", F.col("quota").alias("_quota"), "_size", "_target"), ["_class", "_stratum"])
    by_source = Window.partitionBy("_class", "_stratum", source).orderBy("_draw", key)
    part = part.withColumn("_of_source", F.row_number().over(by_source)).withColumn("_capped", F.col("_of_source") > per_source)
    place = F.row_number().over(Window.partitionBy("_class", "_stratum", "_capped").orderBy("_draw", key))
    picked = ~F.col("_capped") & (F.col("_quota") > 0) & (place <= F.greatest(F.col("_quota"), F.lit(least)))
    part = part.withColumn("_picked", picked)
    # Cutting and filling up are one order: the picked first.
    final = F.row_number().over(Window.partitionBy("_class").orderBy(F.col("_picked").desc(), "_draw", key))
    part = part.withColumn("_final", final).where((F.col("_size") <= F.col("_target")) | (F.col("_final") <= F.col("_target")))
    out = rows.where(F.col("_target").isNull()).select(*df.columns).unionByName(part.select(*df.columns))
    if unique:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(unique).orderBy(draw(seed, key), key))).where("_n = 1").drop("_n")
    return out


def first_per(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order, as an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    out = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return out.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def group_split(df: DataFrame, group: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """df with split: all rows of a group on one side, by its hash."""
    share = F.pmod(draw(seed, group), F.lit(10_000))
    return df.withColumn("split", F.when(share < round(test * 10_000), "test").otherwise("train"))


def folds(df: DataFrame, group: str, k: int, label: str | None = None, seed: int = 42) -> DataFrame:
    """df with fold (0 to k - 1): by the group's hash, or, with label, dealt in turn among groups of like label so that folds have like shares."""
    if label is None:
        return df.withColumn("fold", F.pmod(draw(seed, group), F.lit(k)).cast("int"))
    groups = df.groupBy(group).agg(F.round(F.avg(F.col(label).cast("double")), 1).alias("_mix"), F.count(F.lit(1)).alias("_n"))
    shard = F.pmod(draw(seed + 1, group), F.lit(64))
    turn = F.row_number().over(Window.partitionBy("_mix", shard).orderBy(F.col("_n").desc(), draw(seed, group)))
    dealt = groups.withColumn("fold", F.pmod(turn + F.abs(shard), F.lit(k)).cast("int")).select(group, "fold")
    return df.join(dealt, group)


def temporal_split(df: DataFrame, ts: str, test: float = 0.2) -> DataFrame:
    """df with split: the last part of time (by the quantile of ts) is the test."""
    cut = percentiles(df, ts, [1 - test])
    return df.crossJoin(F.broadcast(cut)).select(*df.columns, F.when(F.col(ts) > F.get("cuts", F.lit(0)), "test").otherwise("train").alias("split"))
