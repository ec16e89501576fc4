"""Projections and filters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.functions.numeric import as_column
from stockweave.schema import TableSpec


def project(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Exactly the schema's fields in schema order."""
    return df.select(*spec.names)


def filter_entities(df: DataFrame, equals: Mapping[str, object]) -> DataFrame:
    """Equality on entity keys, compared as text."""
    for column, value in equals.items():
        df = df.where(F.col(column).cast("string") == str(value))
    return df


def before_origin(df: DataFrame, time: str, origin: object) -> DataFrame:
    """History strictly before the origin."""
    return df.where(F.col(time) < as_column(origin))


def last_n_days(df: DataFrame, time: str, days: int, bounds: DataFrame | None = None) -> DataFrame:
    """Rows of the last ``days`` days of the table; ``bounds`` (``hi``) saves a second pass."""
    last = (df.agg(F.max(time).alias("hi")) if bounds is None else bounds).select("hi").scalar()
    return df.where(F.col(time) > F.date_sub(last, days))


def event_factor(df: DataFrame, events: DataFrame, time: str, multiplier: float) -> DataFrame:
    """``factor`` = multiplier on event dates, else 1 (the event list is one row per event day)."""
    days = events.select(F.col("date").alias("_day")).distinct()
    joined = df.join(days, F.col(time) == F.col("_day"), "left")
    return joined.withColumn("factor", F.when(F.col("_day").isNotNull(), F.lit(float(multiplier))).otherwise(F.lit(1.0))).drop("_day")


def literal_columns(df: DataFrame, values: Mapping[str, object], scenario_id: str | None = None) -> DataFrame:
    """Constant columns and the scenario id (``none`` without a scenario)."""
    columns = {name: F.lit(v).cast("bigint") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v) for name, v in values.items()}
    return df.withColumns({**columns, "scenario_id": F.lit(scenario_id or "none")})
