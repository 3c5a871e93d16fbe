"""What the corpus operators share: table access, shared scratch tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regular expression class body and as characters.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_local_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only on a local master without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="weirflow-")
    return _local_scratch[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/weirflow-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a scratch table, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Scratch tables of one computation, which are deleted when it ends: what it returns must not read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            deleted(self.spark, path)

    def written(self, df: DataFrame, label: str) -> DataFrame:
        """written(), with the table's path kept for deletion."""
        path = f"{scratch_dir(self.spark)}/weirflow-{label}-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def replaced(self, df: DataFrame, label: str, keep: int = 1) -> DataFrame:
        """written(), after which the tables of this label but for the last keep are deleted."""
        out = self.written(df, label)
        mine = [p for p in self.paths if f"/weirflow-{label}-" in p]
        for path in mine[:-keep]:
            deleted(self.spark, path)
            self.paths.remove(path)
        return out


def shard_count(spark: SparkSession, per_partition: int = 4) -> int:
    """How many shards blobs are dealt to: a multiple of the session's shuffle partitions, which the user sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * per_partition)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def null_safe_keys(left: str, right: str, *names: str):
    """A null-safe equality over several columns of two aliased frames."""
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def one_text_each(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and text, one row for each value of keys: of several texts the one with the least hash, so that a repeated id counts once."""
    least = F.min(F.struct(F.xxhash64("text"), F.col("text"))).alias("least")
    return rows.groupBy(*keys).agg(least).select(*keys, "least.text")


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches whose texts (column "text") have about limit bytes, however long the Arrow batches are."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes):
            held += int(size)
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def give_back() -> None:
    """Returns memory that this process has freed to the system: the C library keeps most of what a task freed, and Spark keeps workers for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of mapInArrow, after which its worker is as small as before but for what it caches."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def giving_back_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of applyInArrow, after each group: a small one may have taken much."""

    def whole(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            give_back()

    return whole
