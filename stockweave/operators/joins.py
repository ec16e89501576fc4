"""Joins with declared cardinality, as-of lookups and key-set comparison.

No side carries a broadcast hint here: dimension sizes are not known in advance, so Spark decides by
measured size. Many-to-one checks are part of the plan and fail the job when a key repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unique_dimension(dim: DataFrame, key: Sequence[str]) -> DataFrame:
    """``dim`` with one row per key; a repeated key fails the job when the row is read."""
    values = [c for c in dim.columns if c not in key]
    grouped = dim.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in values])
    problem = F.lit(f"join key is not unique: {', '.join(key)}")
    checked = [F.when(F.col("_n") > 1, F.raise_error(problem).cast(dim.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in values]
    return grouped.select(*key, *checked)


def many_to_one(df: DataFrame, dim: DataFrame, key: Sequence[str], how: str = "inner", hot_left: bool = True) -> DataFrame:
    """Equi-join whose right side must have unique keys; a repeated key fails the job.

    With ``hot_left`` the left side may hold any number of rows per key: uniqueness is then counted
    apart and the join stays a plain one, whose hot keys adaptive execution can split. Left sides
    that are already summed per key pass ``False``: the check then rides on the join's own shuffle
    and the right side is read once.
    """
    if not hot_left:
        return df.join(unique_dimension(dim, key), list(key), how)
    most = dim.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_most")).scalar()
    unique = F.when(most > 1, F.raise_error(F.lit(f"join key is not unique: {', '.join(key)}")).cast("boolean")).otherwise(F.lit(True))
    return df.where(unique).join(dim, list(key), how)


def require_values(df: DataFrame, columns: Sequence[str], message: str) -> DataFrame:
    """Fail the job when one of the columns is null."""

    def checked(name: str) -> Column:
        return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{message}: {name}")).cast(df.schema[name].dataType)).otherwise(F.col(name))

    return df.withColumns({c: checked(c) for c in columns})


def semi_join_series(df: DataFrame, series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in another table."""
    return df.join(series.select(*keys).distinct(), list(keys), "left_semi")


def orphan_keys(child: DataFrame, fields: Sequence[str], parent: DataFrame, ref_fields: Sequence[str]) -> DataFrame:
    """Child keys without a parent and their row counts; rows with a null key part are left out.

    Child rows are counted per key before the join, so a hot key is one row by then.
    """
    keys = child.select(*fields).dropna().groupBy(*fields).agg(F.count(F.lit(1)).alias("rows"))
    parents = parent.select(*[F.col(r).alias(f"_ref_{i}") for i, r in enumerate(ref_fields)])
    on = [F.col(f) == F.col(f"_ref_{i}") for i, f in enumerate(fields)]
    condition = on[0]
    for extra in on[1:]:
        condition = condition & extra
    return keys.join(parents, condition, "left_anti")


def keyset_compare(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, tagged ``missing`` (not found) or ``unexpected``."""
    left = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    right = found.select(*keys).distinct().withColumn("_f", F.lit(True))
    both = left.join(right, list(keys), "full_outer")
    side = F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
    return both.select(*keys, side.alias("side")).where(F.col("side").isNotNull())


def asof_latest(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, origin: str) -> DataFrame:
    """Adds the latest ``origin <= time`` per entity; null when there is none.

    Only distinct (entity, day) pairs enter the window, so an entity's window is bounded by the
    calendar however many rows it has; the answer then returns to all rows by an equi-join.
    """
    days = left.select(*by, F.col(time).alias("_at"), F.lit(None).cast(right.schema[origin].dataType).alias("_origin"))
    known = right.select(*by, F.col(origin).alias("_at"), F.col(origin).alias("_origin"))
    pairs = days.unionByName(known).groupBy(*by, "_at").agg(F.max("_origin").alias("_origin"))
    upto = W.partitionBy(*by).orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    latest = pairs.select(*by, F.col("_at").alias(time), F.max("_origin").over(upto).alias(origin))
    return left.join(latest, [*by, time], "left")
