"""Date and origin spines, gap-free grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.numeric import as_column


def date_sequence(start: object, end: object, step_days: int = 1) -> Column:
    """Array of dates from ``start`` to ``end`` inclusive; empty when the end comes first."""
    first, last = as_column(start).cast("date"), as_column(end).cast("date")
    dates = F.sequence(first, last, F.expr(f"interval {int(step_days)} day"))
    return F.when(last >= first, dates).otherwise(F.array().cast("array<date>"))


def date_spine(bounds: DataFrame, start: object, end: object, name: str = "date") -> DataFrame:
    """Every day between two dates, one spine per row of ``bounds``."""
    return bounds.select(F.explode(date_sequence(start, end)).alias(name))


def origin_spine(bounds: DataFrame, start: object, end: object, step_days: int, name: str = "origin_date") -> DataFrame:
    """``start, start + k, ... <= end``; an end before the start is an error."""
    first, last = as_column(start).cast("date"), as_column(end).cast("date")
    checked = F.when(last < first, F.raise_error(F.lit("horizon end is before its start")).cast("date")).otherwise(last)
    return bounds.select(F.explode(F.sequence(first, checked, F.expr(f"interval {int(step_days)} day"))).alias(name))


def value_bounds(df: DataFrame, column: str) -> DataFrame:
    """One row with the smallest and largest value of a column."""
    return df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))


def keyed_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with every key present (plain predicates, which the optimizer can push and match)."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def grid_sum(df: DataFrame, time: str, entities: Sequence[str], value: str) -> DataFrame:
    """Sum of a value per day and entity (partial sums first, so a hot entity is harmless)."""
    return df.groupBy(time, *entities).agg(F.sum(value).alias(value))


def reindex_to_spine(
    df: DataFrame, time: str, entities: Sequence[str], value: str, bounds: DataFrame | None = None
) -> DataFrame:
    """Every entity on every day between the global first and last day.

    ``observed`` tells real cells from filled ones (their value is null). Each entity row makes its
    own days with ``sequence``; there is no entity-by-date cross product of tables.
    ``bounds`` (one row ``lo, hi``) avoids reading the input again where the range is known.
    """
    limits = value_bounds(df, time) if bounds is None else bounds
    lo, hi = limits.select("lo").scalar(), limits.select("hi").scalar()
    # Rows without a key have no cell. Saying so here, and keeping the value column in the entity
    # branch by an always-true filter, gives both branches the same plan below the aggregation: Spark
    # then reuses one shuffle instead of reading the source twice.
    df = keyed_rows(df, [time, *entities])
    known = df.groupBy(*entities).agg(F.count(value).alias("_cells")).where(F.col("_cells") >= 0)
    spine = known.select(F.explode(date_sequence(lo, hi)).alias(time), *entities)
    keys = [time, *entities]
    cells = df.select(*keys, F.col(value), F.lit(True).alias("observed"))
    joined = spine.join(cells, keys, "left")
    return joined.select(*keys, value, F.coalesce("observed", F.lit(False)).alias("observed"))


def observed_grid(
    df: DataFrame, time: str, entities: Sequence[str], value: str, bounds: DataFrame | None = None
) -> DataFrame:
    """Daily sums on the full spine, gaps filled with 0 and flagged."""
    daily = grid_sum(df, time, entities, value)
    full = reindex_to_spine(daily, time, entities, value, bounds)
    filled = F.coalesce(F.col(value), F.lit(0)).cast(daily.schema[value].dataType)
    return full.withColumn(value, filled)
