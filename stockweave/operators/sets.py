"""Sorting, previews and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_by_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Global order by key, for sinks (a range-partitioned sort)."""
    return df.orderBy(*key)


def preview(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in key order as JSON text with ISO dates."""
    if n < 0:
        raise ValueError("n must be >= 0")
    return df.orderBy(*key).limit(n).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))


def newest_first(df: DataFrame, sequence: str) -> DataFrame:
    return df.orderBy(F.desc(sequence))


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that both sides have."""
    return left.intersect(right)


def only_in_first(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of the first side that the second lacks."""
    return left.subtract(right)
