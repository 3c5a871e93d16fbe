"""Unions of tables whose columns differ, and cleaning of tables that were put together from files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def without_headers(df: DataFrame) -> DataFrame:
    """df without rows that repeat the header or hold nothing."""
    first = df.columns[0]
    return df.where(~F.coalesce(F.trim(F.col(f"`{first}`").cast("string")) == first.strip(), F.lit(False))).dropna("all")


def aligned(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """names in their order, null where df lacks one."""
    by_name = {c.strip(): c for c in df.columns}
    return df.select(*[(F.col(f"`{by_name[n]}`") if n in by_name else F.lit(None).cast("string")).alias(n) for n in names])


def keys_in_common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def keys_only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def attack_rows(df: DataFrame, label: str) -> DataFrame:
    """Rows that name an attack."""
    text = F.lower(F.trim(F.coalesce(F.col(label).cast("string"), F.lit(""))))
    return df.where(~text.isin("", "nan", "none", "benign"))


def valid_benign(df: DataFrame, label: str, flow_id: str) -> DataFrame:
    """Rows that have both a label and an id."""
    there = lambda c: F.coalesce(~F.lower(F.trim(F.col(c).cast("string"))).isin("", "nan"), F.lit(False))
    return df.where(there(label) & there(flow_id))
