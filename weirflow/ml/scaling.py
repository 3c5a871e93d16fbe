"""Standard scores by population deviation, as plain columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    names: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    def scaled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: (F.col(n) - F.lit(m)) / F.lit(d) for n, m, d in zip(self.names, self.means, self.deviations)})


def fit_scaler(df: DataFrame, names: tuple[str, ...]) -> Scaler:
    """Means and deviations in one aggregate; a column that does not vary is only centred."""
    row = df.agg(*[f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    means = tuple(float(row[f"m{i}"] or 0.0) for i in range(len(names)))
    return Scaler(names, means, tuple(float(row[f"d{i}"] or 0.0) or 1.0 for i in range(len(names))))
