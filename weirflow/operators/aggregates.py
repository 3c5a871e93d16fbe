"""Counts, audits and evaluation measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.operators.sampling import percentiles, running


def counts(df: DataFrame, *by: str, most: int | None = None) -> DataFrame:
    """Rows by group, the largest groups first."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *by)
    return out.limit(most) if most is not None else out


def shares(df: DataFrame, **conditions: Column) -> DataFrame:
    """n, and for each condition its count and percentage, in one pass."""
    columns = [F.count(F.lit(1)).alias("n")]
    for name, c in conditions.items():
        columns.append(F.count_if(c).alias(f"n_{name}"))
    out = df.agg(*columns)
    return out.withColumns({f"pct_{name}": F.coalesce(F.try_divide(100.0 * F.col(f"n_{name}"), F.col("n")), F.lit(0.0)) for name in conditions})


def distribution(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, value, n, share of the group's rows."""
    out = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def frequent(df: DataFrame, key: str, least: int) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label: the least and greatest differ, which combines before the shuffle."""
    out = df.groupBy(key).agg(F.min(label).alias("low"), F.max(label).alias("high"), F.count(F.lit(1)).alias("n"))
    return out.where("low <> high")


def key_audit(df: DataFrame, key: str) -> DataFrame:
    """n_rows, n_unique, rows_in_repeats, max_per_key."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_repeats"), F.coalesce(F.max("n"), F.lit(0)).alias("max_per_key"))


def _long(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """A row for each column's value, so that a wide table is aggregated in one pass with a short plan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.value")


def feature_health(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, n, n_not_finite, mean, deviation (population), nonzero share, constant, all_zero."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    value = F.when(finite, F.col("value"))
    out = _long(df, columns).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(~finite).alias("n_not_finite"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.avg((value != 0).cast("double")).alias("nonzero"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return out.withColumn("constant", F.col("_lo") == F.col("_hi")).withColumn("all_zero", (F.col("_lo") == 0) & (F.col("_hi") == 0)).drop("_lo", "_hi")


def uniqueness(df: DataFrame, columns: Sequence[str], above: float = 0.9, exact: bool = True) -> DataFrame:
    """feature, n_unique, ratio, suspicious (ratio > above)."""
    distinct = F.countDistinct("value") if exact else F.approx_count_distinct("value", 0.01)
    out = _long(df, columns).groupBy("feature").agg(distinct.alias("n_unique"), (distinct / F.count(F.lit(1))).alias("ratio"))
    return out.withColumn("suspicious", F.col("ratio") > above)


def separability(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """feature, label, mean, deviation (sample), n."""
    return _long(df, columns, label).groupBy("feature", label).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"), F.count("value").alias("n"))


def label_correlation(df: DataFrame, columns: Sequence[str], label: str, above: float = 0.9) -> DataFrame:
    """feature, correlation, suspicious."""
    out = _long(df, columns, label).groupBy("feature").agg(F.corr("value", F.col(label).cast("double")).alias("correlation"))
    return out.withColumn("suspicious", F.coalesce(F.abs("correlation") > above, F.lit(False)))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, correlation of all pairs of columns a < b, in one aggregate over the table."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    made = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(made))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (from 0), n: equal widths between the least and greatest value, found by an aggregate first."""
    value = F.col(column).cast("double")
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((value - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(0)
    return df.where(value.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def exact_duplicates(df: DataFrame) -> DataFrame:
    """n_rows, n_distinct, n_duplicates."""
    sizes = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def near_overlap(train: DataFrame, test: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """n_shared: distinct rows that two splits share when rounded."""
    rounded = lambda df: df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) for c in columns])
    return rounded(train).intersect(rounded(test)).agg(F.count(F.lit(1)).alias("n_shared"))


def balance(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """label, train, test (shares of the split), delta."""
    both = train.select(label, F.lit("train").alias("_s")).unionByName(test.select(label, F.lit("test").alias("_s")))
    n = both.groupBy(label).agg(F.count_if(F.col("_s") == "train").alias("a"), F.count_if(F.col("_s") == "test").alias("b"))
    every = Window.partitionBy()
    part = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(every)), F.lit(0.0))
    return n.select(label, part("a").alias("train"), part("b").alias("test")).withColumn("delta", F.abs(F.col("train") - F.col("test")))


def run_summary(df: DataFrame, seconds: float | None = None) -> DataFrame:
    """Totals of scored rows (risk, decision): counts by tier, mean and greatest risk, and rows a second if the time is given."""
    out = df.agg(
        F.count(F.lit(1)).alias("total_processed"),
        *[F.count_if(F.col("decision") == t).alias(f"count_{t.lower()}") for t in ("LOW", "MEDIUM", "HIGH")],
        F.coalesce(F.sum("risk"), F.lit(0.0)).alias("sum_risk"),
        F.coalesce(F.max("risk"), F.lit(0.0)).alias("max_risk"),
        F.coalesce(F.avg("risk"), F.lit(0.0)).alias("avg_risk"),
    )
    return out if seconds is None else out.withColumn("duration_sec", F.lit(round(seconds, 2))).withColumn("events_per_sec", F.round(F.try_divide(F.col("total_processed"), F.lit(seconds)), 2))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """tp, fp, tn, fn, accuracy, false positive rate, precision, recall, f1 of 0/1 columns."""
    a, p = F.col(label) == 1, F.col(predicted) == 1
    out = df.agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(~a & ~p).alias("tn"), F.count_if(a & ~p).alias("fn"))
    over = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.withColumns({"accuracy": over(tp + tn, tp + fp + tn + fn), "fpr": over(fp, fp + tn), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "f1": over(2 * tp, 2 * tp + fp + fn)})


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support of each class."""
    cells = df.groupBy(F.col(label).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("q")), F.struct(F.col("p").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("q")))).alias("s"), "n", (F.col("a") == F.col("p")).alias("same"))
    total = sides.groupBy("s.label").agg(F.sum(F.col("n") * F.col("s.t")).alias("support"), F.sum(F.col("n") * F.col("s.q")).alias("guessed"), F.sum(F.when(F.col("same"), F.col("n") * F.col("s.t")).otherwise(0)).alias("right"))
    over = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y)), F.lit(0.0))
    out = total.withColumn("precision", over("right", "guessed")).withColumn("recall", over("right", "support"))
    return out.select("label", "precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"), "support")


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auc: the chance that a positive scores above a negative, ties half. Rows are first counted by score, so that only distinct scores are ranked."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))
    wins = running(by.where("s is not null"), "s", "n").withColumn("w", F.col("p") * (F.col("before") + F.col("n") / 2.0))
    return wins.agg(F.try_divide(F.sum("w"), F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def best_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, f1, recall: the best by f1 of the scores' percentiles 5, 10 .. 95."""
    cuts = percentiles(df, score, [k / 100 for k in range(5, 100, 5)])
    marked = df.select(label, score).crossJoin(F.broadcast(cuts))
    a = F.col(label) == 1
    sums = []
    for k in range(19):
        hit = F.col(score) >= F.get("cuts", F.lit(k))
        sums += [F.count_if(a & hit).alias(f"tp{k}"), F.count_if(~a & hit).alias(f"fp{k}")]
    one = marked.agg(*sums, F.count_if(a).alias("all"), F.first("cuts").alias("cuts"))
    f1 = lambda k: F.coalesce(F.try_divide(2.0 * F.col(f"tp{k}"), F.col(f"tp{k}") + F.col(f"fp{k}") + F.col("all")), F.lit(0.0))
    options = F.array(*[F.struct(f1(k).alias("f1"), F.get("cuts", F.lit(k)).alias("threshold"), F.coalesce(F.try_divide(F.col(f"tp{k}").cast("double"), F.col("all")), F.lit(0.0)).alias("recall")) for k in range(19)])
    return one.select(F.array_max(options).alias("b")).select("b.threshold", "b.f1", "b.recall")


def scores_by_class(df: DataFrame, label: str, score: str, tier: str) -> DataFrame:
    """label, n, mean, least and greatest score, count by tier."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.min(score).alias("low"), F.max(score).alias("high"), *[F.count_if(F.col(tier) == t).alias(f"n_{t.lower()}") for t in ("LOW", "MEDIUM", "HIGH")])


def verification(df: DataFrame, label: str, wanted: int) -> DataFrame:
    """n_rows, n_bad_label: rows whose label is not the wanted one."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col(label).cast("string").eqNullSafe(F.lit(str(wanted)))).alias("n_bad_label"))


def first_block(df: DataFrame, ts: str = "ts_us", action: str = "action") -> DataFrame:
    """first_us, latency_us: the first blocked row's time, and how long after the first row that is."""
    out = df.agg(F.min(ts).alias("start_us"), F.min(F.when(F.col(action) == "BLOCK", F.col(ts))).alias("first_us"))
    return out.select("first_us", (F.col("first_us") - F.col("start_us")).alias("latency_us"))


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def weak_report(df: DataFrame) -> DataFrame:
    """tier, rule, n, removed, pct_removed of all rows (columns tier, rule, keep)."""
    out = df.groupBy("tier", "rule").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("keep")).alias("removed"))
    return out.withColumn("pct_removed", 100.0 * F.col("removed") / F.sum("n").over(Window.partitionBy()))
