"""An isolation forest: trees over bounded random subsets, scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def path_length(n: float) -> float:
    """The mean depth of a point in a random tree of n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


@dataclass
class Tree:
    """Nodes by number: column (-1: leaf), cut, children, and the depth that a leaf stands for."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray

    def depths(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            column = self.column[node]
            inner = column >= 0
            if not inner.any():
                return self.depth[node]
            rows = np.flatnonzero(inner)
            at = node[rows]
            low = x[rows, column[rows]] <= self.cut[at]
            node[rows] = np.where(low, self.left[at], self.right[at])


def grow(x: np.ndarray, rng: np.random.Generator) -> Tree:
    nodes: list[list[float]] = []
    most = math.ceil(math.log2(max(2, len(x))))

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + path_length(len(rows))])
        low, high = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= most or len(rows) <= 1 or not len(varied):
            return at
        column = int(rng.choice(varied))
        cut = float(rng.uniform(low[column], high[column]))
        side = rows[:, column] <= cut
        nodes[at][:4] = [column, cut, add(rows[side], depth + 1), add(rows[~side], depth + 1)]
        return at

    add(x, 0)
    table = np.array(nodes, float)
    return Tree(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4])


@dataclass
class Forest:
    names: tuple[str, ...]
    trees: list[Tree]
    sample: int
    offset: float = -0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        mean = sum(t.depths(x) for t in self.trees) / max(1, len(self.trees))
        return -np.power(2.0, -mean / max(1e-9, path_length(self.sample)))

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Lower is more anomalous; below 0 for the contaminated part of what it was fitted on."""
        return self.raw(x) - self.offset

    def scored(self, df: DataFrame, name: str = "if_raw") -> DataFrame:
        schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
        shared, names = df.sparkSession.sparkContext.broadcast(self), list(self.names)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = np.nan_to_num(batch[names].to_numpy(float))
                yield batch.assign(**{name: shared.value.decision(x) if len(x) else np.zeros(0)})

        return df.mapInPandas(run, schema)


def fit_forest(df: DataFrame, names: tuple[str, ...], key: str, trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 42) -> Forest:
    """A forest of trees, each over `sample` rows. The rows are the trees * sample with the least seeded hashes of key, so that the driver holds no more than these."""
    rows = df.select(*[F.col(n).cast("double") for n in names], key).orderBy(F.xxhash64(F.lit(seed), key), key).limit(trees * sample).drop(key).toPandas()
    x, rng = np.nan_to_num(rows.to_numpy(float)), np.random.default_rng(seed)
    size = min(sample, len(x))
    if not size:
        return Forest(names, [], 1)
    forest = Forest(names, [grow(x[rng.choice(len(x), size, replace=False)], rng) for _ in range(trees)], size)
    forest.offset = float(np.percentile(forest.raw(x), 100 * contamination))
    return forest
