"""Statistics over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def entropy_of_counts(counts: Column, eps: float = EPS) -> Column:
    """Entropy in bits of an array of counts, eps added to each probability inside the logarithm; 0 without counts."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    bits = lambda c, n: F.aggregate(F.filter(c, lambda x: x > 0), F.lit(0.0), lambda a, x: a - (x / n) * F.log2(x / n + F.lit(eps)))
    return let(counts.cast("array<double>"), lambda c: let(total(c), lambda n: F.when(n > 0, bits(c, n)).otherwise(0.0)))


def value_counts(values: Column) -> Column:
    """Counts of an array's distinct values, in the order of their first places."""
    return let(values, lambda v: F.transform(F.array_distinct(v), lambda x: F.size(F.filter(v, lambda y: y.eqNullSafe(x)))))


def entropy(values: Column, eps: float = EPS) -> Column:
    return entropy_of_counts(value_counts(values), eps)


def gaps(times: Column) -> Column:
    """Differences of neighbours in the sorted array."""
    return let(F.sort_array(times), lambda t: F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: x - F.get(t, i)))


def _moments(values: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    return F.aggregate(values, zero, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))


def mean_of(values: Column) -> Column:
    return let(_moments(values.cast("array<double>")), lambda m: F.when(m["n"] > 0, m["s"] / m["n"]).otherwise(0.0))


def variance_of(values: Column) -> Column:
    """Population variance in two passes; 0 with fewer than two values."""
    return let(values.cast("array<double>"), lambda v: let(mean_of(v), lambda m: F.when(F.size(v) >= 2, mean_of(F.transform(v, lambda x: (x - m) * (x - m)))).otherwise(0.0)))


def variation(values: Column, eps: float = EPS) -> Column:
    """Population standard deviation over the mean plus eps; 0 without values."""
    return F.when(F.size(values) > 0, F.sqrt(variance_of(values)) / (mean_of(values) + eps)).otherwise(0.0)


def autocorrelation(values: Column, eps: float = EPS) -> Column:
    """Correlation of an array with itself one place on; 0 with fewer than three values or where either side hardly varies."""

    def of(v: Column) -> Column:
        x, y = F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1)
        mx, my, sx, sy = mean_of(x), mean_of(y), F.sqrt(variance_of(x)), F.sqrt(variance_of(y))
        both = mean_of(F.zip_with(x, y, lambda a, b: a * b))
        return F.when((sx > eps) & (sy > eps), (both - mx * my) / (sx * sy)).otherwise(0.0)

    return let(values.cast("array<double>"), lambda v: F.when(F.size(v) >= 3, of(v)).otherwise(0.0))


def first_mode(values: Column) -> Column:
    """The most frequent value, of equals the one that comes first; null without values."""
    return let(values, lambda v: let(value_counts(v), lambda c: F.when(F.size(v) > 0, F.get(F.array_distinct(v), (F.array_position(c, F.array_max(c)) - 1).cast("int")))))
