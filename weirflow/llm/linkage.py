"""Connected components of a graph in a table, by alternating large and small stars, or in one task where a count says that there are few edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import Scratch, giving_back


#: Edges (16 bytes each) that one task may hold. Rounds of stars over so few take a hundred small stages, whose tasks the driver keeps records of.
FEW = 1 << 20


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), and the smallest node that links reach from each."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    label, ends = np.arange(len(names)), ends.reshape(2, -1)
    while True:
        # Labels are roots here: the larger root of an edge goes to the smaller one, and then all nodes to their root.
        roots = label[ends]
        apart = roots[0] != roots[1]
        if not apart.any():
            return names, names[label]
        ends, roots = ends[:, apart], roots[:, apart]
        np.minimum.at(label, roots.max(axis=0), roots.min(axis=0))
        while (label != label[label]).any():
            label = label[label]


@giving_back
def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if edges:
        nodes, labels = least_labels(*(np.concatenate(c) for c in zip(*edges)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["node", "label"])


def components(edges: DataFrame, scratch: Scratch, few: int = FEW) -> DataFrame:
    """node, label of every node in edges (columns u, v, long): label is the smallest node that links reach.

    Each round joins every node's larger neighbours, then its smaller ones, to the least neighbour; both take aggregates
    of a node's neighbours and a join, never a list of them. Rounds end when the table of edges no longer changes. Only the
    last table of edges, which the result reads, is left in scratch. At most few distinct edges are not worth rounds: one task finds their components.
    """
    now = scratch.replaced(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen is None and 0 < state[0] <= few:
            return now.coalesce(1).mapInArrow(_solved, "node long, label long")
        if state == seen or state[0] == 0:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(now.select(F.col("v").alias("node")).distinct().join(now.select(F.col("u").alias("node")), "node", "left_anti").withColumn("label", F.col("node")))
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.replaced(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
