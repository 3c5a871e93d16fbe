"""Quality rules whose cutoffs are certified on labelled rows, with DataFrame and SQL functions only.

Fixed base rules come first. Each further rule compares one value of a text with a cutoff from a fixed grid. Rows
labelled clean are the holdout: on each stratum (a band of text length) the grid is walked from the loosest cutoff to
the tightest, and a cutoff is certified while the exact binomial tail says that a false rejection rate above the limit
would show as few rejections as were seen with probability at most delta / (rules * strata). A walk that stops at its first
failure needs no further correction, so that with probability 1 - delta no certified cutoff has a false rejection rate above
its limit. Of the certified cutoffs a rule uses the one that rejects the most low-quality rows, net of a price for clean ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.llm.common import SPACE, SPACE_CHARS, written

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Rules' values are shares or small ratios; a document is rejected where a value is above the rule's cutoff.
RULES = ("symbols", "repeats", "lines", "capitals", "marks", "word_length")
#: The grid, the same for all: cutoffs from 1 / 64 by a fourth root of 2; word_length counts in units of 20 code points.
GRID = 33
CUTOFF = "pow(2.0D, rung / 4.0D) / 64.0D"
BANDS = (100, 400)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more, from hashes of all windows."""
    grams = F.transform(
        F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = let(placed, lambda p: F.transform(F.filter(p, lambda x, i: (F.get(p, i - 1)["g"] == x["g"]) | (F.get(p, i + 1)["g"] == x["g"])), lambda x: x["i"]))
        steps = let(F.sort_array(twice), lambda s: F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, the counts of the base rules and the values of RULES, over whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    words = F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")
    with_word = F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, SPACE_CHARS, "")) > 0)
    out = docs.select(
        "doc_id",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeats"))).alias("w"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(with_word, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        F.regexp_count("text", F.lit("\\p{Lu}")).alias("upper"),
        F.regexp_count("text", F.lit("[^\\p{L}\\p{N}\\s]")).alias("marks"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    n = F.col("w.n")
    failed = (n < 20) | (100 * F.col("w.repeats") > 30 * n)
    return out.select(
        "doc_id",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.dup").alias("n_dup_lines"),
        F.col("w.repeats").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (F.when(n < BANDS[0], 0).when(n < BANDS[1], 1).otherwise(2)).alias("stratum"),
        ratio(F.col("n_symbols"), n).alias("symbols"),
        ratio(F.col("w.repeats"), n).alias("repeats"),
        ratio(F.col("l.dup"), F.col("l.n")).alias("lines"),
        ratio(F.col("upper"), F.col("word_chars")).alias("capitals"),
        ratio(F.col("marks"), F.col("word_chars")).alias("marks"),
        (ratio(F.col("word_chars"), n) / 20).alias("word_length"),
    )


def tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for X binomial (n, rate), summed term by term in logarithms; 1 where k is above the mean."""
    odds = F.lit(rate) / (1 - F.lit(rate))
    first = n * F.log1p(F.lit(-rate))

    def step(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i * odds)
        high, low = F.greatest(term, state["sum"]), F.least(term, state["sum"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(terms, F.struct(first.cast("double").alias("term"), first.cast("double").alias("sum")), step, lambda s: F.exp(s["sum"]))
    return F.when(k > n * rate, F.lit(1.0)).otherwise(total)


def certified(values: DataFrame, labels: DataFrame, limit: float, delta: float, price: float) -> DataFrame:
    """stratum, rule, cutoff: the chosen cutoff of each rule that has a certified one. values as by measured()."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = values.where("not base_failed").join(known, "doc_id")
    stack = ", ".join(f"'{r}', {r}" for r in RULES)
    rows = rows.selectExpr("stratum", "quality", f"stack({len(RULES)}, {stack}) as (rule, value)")
    # A value rejects at each cutoff below it, at rungs 0 to its own.
    rung = F.when(F.col("value") > 0, F.ceil(4 * F.log2(F.col("value") * 64)) - 1).otherwise(-1)
    counts = rows.groupBy("stratum", "rule", F.least(F.lit(GRID - 1), F.greatest(F.lit(-1), rung)).cast("int").alias("rung")).agg(
        F.count_if(F.col("quality") == 1).alias("clean"), F.count_if(F.col("quality") == 0).alias("low")
    )
    grid = counts.select("stratum", "rule").distinct().withColumn("rung", F.explode(F.sequence(F.lit(-1), F.lit(GRID - 1)))).join(counts, ["stratum", "rule", "rung"], "left").na.fill(0, ["clean", "low"])
    own = Window.partitionBy("stratum", "rule")
    above = own.orderBy(F.col("rung").desc()).rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.select("stratum", "rule", "rung", F.sum("clean").over(own).alias("n"), F.sum("clean").over(above).alias("k"), F.sum("low").over(above).alias("hits")).where("rung >= 0")
    level = delta / (len(RULES) * (len(BANDS) + 1))
    grid = grid.withColumn("fails", (tail(F.col("n"), F.col("k"), limit / len(RULES)) > level).cast("int"))
    walk = grid.withColumn("failed", F.sum("fails").over(above)).where("failed = 0 and hits > 0").withColumn("gain", F.col("hits") - price * F.col("k"))
    best = walk.where("gain > 0").groupBy("stratum", "rule").agg(F.max(F.struct("gain", "rung")).alias("best"))
    return best.select("stratum", "rule", F.col("best.rung").alias("rung")).selectExpr("stratum", "rule", f"{CUTOFF} as cutoff")


def judged(documents: DataFrame, labels: DataFrame, limit: float = 0.02, delta: float = 0.05, price: float = 100.0) -> DataFrame:
    """One row per document: doc_id, n_words, the four counts, base_failed, kept.

    documents needs doc_id and text, labels doc_id and quality (1 clean, 0 low); other columns are ignored. A null text
    is empty and fails the base rules. A null quality is no label; where a doc_id has several labels the highest holds. Rows
    that repeat are judged each. Without enough labels no cutoff can be certified, and only the base rules reject. limit is
    the rate of clean rows of a stratum that all certified rules together may reject, delta the chance that it is exceeded. price is the number of low rows that must go for each clean one.
    """
    values = written(measured(documents), "quality")
    chosen = certified(values, labels, limit, delta, price)
    # At most a row for each stratum, whatever the input.
    cuts = chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    cuts = cuts.select("stratum", *[F.col(r).alias(f"cut_{r}") for r in RULES])
    out = values.join(F.broadcast(cuts), "stratum", "left")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"))
