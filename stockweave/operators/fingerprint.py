"""Order-insensitive content fingerprints.

Each row becomes a 48-bit number (MD5 over its values in column-name order, each with its length in front, so that
different rows have different texts); the numbers are
summed, which needs one map-side combined aggregate and no sort. Row order, column order and
partitioning do not matter; row multiplicity does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.functions.random import hash48

# How Spark types are named in a fingerprint.
KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float",
         "string": "str", "boolean": "bool", "date": "date", "timestamp_ntz": "datetime", "timestamp": "datetime"}
FIELD_SEPARATOR = "\x1f"


def _normal_text(name: str, dtype: T.DataType, scale: int | None) -> Column:
    value = F.col(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        if scale is not None:
            text = F.rint(value * float(10**scale)).cast("bigint").cast("string")
        else:
            text = F.when(value == 0, F.lit("0.0")).otherwise(value.cast("double").cast("string"))
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.lit("v"), F.length(text).cast("string"), F.lit(":"), text), F.lit("n"))


def row_text(df: DataFrame, columns: list[str] | None = None, float_scale: int | None = None) -> Column:
    names = sorted(columns or df.columns)
    return F.concat_ws(FIELD_SEPARATOR, *[_normal_text(n, df.schema[n].dataType, float_scale) for n in names])


def column_summary(df: DataFrame, columns: list[str] | None = None) -> str:
    names = sorted(columns or df.columns)
    kinds = [KINDS.get(df.schema[n].dataType.simpleString(), df.schema[n].dataType.simpleString()) for n in names]
    return ",".join(f"{n}:{k}" for n, k in zip(names, kinds))


def row_hash_sum(df: DataFrame, columns: list[str] | None = None, float_scale: int | None = None) -> Column:
    """Aggregate: exact sum of the row numbers (decimal, so it cannot overflow)."""
    return F.sum(hash48(row_text(df, columns, float_scale)).cast("decimal(28,0)"))


def fingerprint_text(df: DataFrame, row_count: int, hash_sum: object) -> str:
    """The fingerprint for totals that are already known (same text as ``content_fingerprint``)."""
    summary = f"{column_summary(df)}|{row_count}|{hash_sum or 0}"
    return hashlib.sha256(summary.encode()).hexdigest()


def content_fingerprint(df: DataFrame, by: tuple[str, ...] = (), float_scale: int | None = None) -> DataFrame:
    """``(row_count, fingerprint)``, overall or per group of ``by`` columns."""
    columns = [c for c in df.columns if c not in by]
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), row_hash_sum(df, columns, float_scale).alias("_sum"))
    summary = F.concat_ws(
        "|", F.lit(column_summary(df, columns)), F.col("row_count").cast("string"), F.coalesce(F.col("_sum"), F.lit(0)).cast("decimal(38,0)").cast("string")
    )
    return totals.select(*by, "row_count", F.sha2(summary, 256).alias("fingerprint"))


def bundle_fingerprint(members: DataFrame, by: tuple[str, ...] = (), name: str = "name", fingerprint: str = "fingerprint") -> DataFrame:
    """SHA-256 over the sorted ``name=fingerprint`` lines of a bundle (a bundle has few tables)."""
    line = F.concat(F.col(name), F.lit("="), F.col(fingerprint))
    joined = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return members.groupBy(*by).agg(F.sha2(joined, 256).alias("bundle_fingerprint"))


def union_fingerprints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One fingerprint row per named table."""
    parts = [content_fingerprint(df).select(F.lit(name).alias("name"), "row_count", "fingerprint") for name, df in sorted(tables.items())]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
