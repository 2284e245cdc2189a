"""Set operations that keep first places, and conflicts under a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct keys with the place where each is first seen; combined before the shuffle."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def first_by_signature(df: DataFrame, same: list[str], members: str, order: str) -> DataFrame:
    """Of rows with the same values and the same set of members (in any order) the first."""
    names = [c for c in df.columns if c != order]
    key = df.select(*[F.col(c).alias(f"key_{c}") for c in same], F.array_sort(F.array_distinct(members)).alias("key_members"), F.struct(order, *names).alias("row"))
    first = key.groupBy(*[f"key_{c}" for c in same], "key_members").agg(F.min_by("row", f"row.{order}").alias("row"))
    return first.select("row.*")


def conflicts(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keys that come with different values; nulls are values too."""
    return df.groupBy(key).agg(F.count_distinct(F.xxhash64(*values)).alias("variants"), F.count("*").alias("n")).where("variants > 1")


def without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys are not in ``other``."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")
