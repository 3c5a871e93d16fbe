"""A source that follows a growing log on a shared file system, over rotations: spark.readStream.format("tail")."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from weirflow.sources.eve import parsed

#: Bytes of a log that one task reads.
RANGE = 64 << 20


class Range(InputPartition):
    """Bytes of one file: lines that begin in them."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Tail(DataSource):
    """Lines of a log (option path) as value, path and place (the byte at which they begin); option from is start or end."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string, path string, place long"

    def streamReader(self, schema) -> "TailReader":
        return TailReader(self.options["path"], self.options.get("from", "start"))


class TailReader(DataSourceStreamReader):
    """Offsets are a file's inode and the end of its last whole line. A file that was moved away is read to its end under its new name."""

    def __init__(self, path: str, begin: str):
        self.path, self.begin = path, begin

    def _now(self) -> dict:
        try:
            with open(self.path, "rb") as f:
                inode, size = os.fstat(f.fileno()).st_ino, os.fstat(f.fileno()).st_size
                return {"inode": inode, "place": _last_line_end(f, size)}
        except FileNotFoundError:
            return {"inode": 0, "place": 0}

    def initialOffset(self) -> dict:
        now = self._now()
        return now if self.begin == "end" else {"inode": now["inode"], "place": 0}

    def latestOffset(self) -> dict:
        return self._now()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if start["inode"] == end["inode"]:
            return _ranges(self.path, start["place"], end["place"])
        moved = _named(os.path.dirname(self.path) or ".", start["inode"])
        rest = _ranges(moved, start["place"], os.path.getsize(moved)) if moved else []
        return rest + _ranges(self.path, 0, end["place"])

    def read(self, partition: Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(max(0, partition.start - 1))
            if partition.start:
                f.readline()  # the line that began before
            while (place := f.tell()) < partition.end and (line := f.readline()):
                yield line.rstrip(b"\r\n").decode("utf-8", "replace"), self.path, place

    def commit(self, end: dict) -> None:
        pass


def _last_line_end(f, size: int, step: int = 1 << 16) -> int:
    """Where the last whole line of a file of this size ends."""
    while size > 0:
        start = max(0, size - step)
        f.seek(start)
        at = f.read(size - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        size = start
    return 0


def _ranges(path: str, start: int, end: int) -> list[Range]:
    return [Range(path, at, min(at + RANGE, end)) for at in range(start, end, RANGE)]


def _named(folder: str, inode: int) -> str | None:
    """The file of a folder that has an inode now."""
    return next((e.path for e in os.scandir(folder) if e.is_file() and e.inode() == inode), None)


def read_tail(spark: SparkSession, path: str, types: tuple[str, ...] | None = None, begin: str = "start") -> DataFrame:
    """Events of a growing log; seq is a hash of the line and its place, as the numbers of lines begin anew in a rotated log."""
    spark.dataSource.register(Tail)
    lines = spark.readStream.format("tail").option("path", path).option("from", begin).load()
    return parsed(lines.select("value", "path", F.xxhash64("value", "place").alias("seq")), types)
