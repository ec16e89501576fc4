"""Calibration and accuracy kept as sums that take new months in and let old ones go.

A month of a series is at most seven cells: per weekday the days, the days from the month's first sale on, units and squared units.
Cells of a month depend on that month alone, so a stored table partitioned by month grows by one partition, and a window that
moves on reads fewer partitions. History counts from the first sale ever: months before it not at all, its own month
from that sale on, later months whole. Profiles from the cells equal those of the full run from the window's first day.

Accuracy is kept per model, origin and series as counts and sums, which add up to any grouping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockweave.functions.numeric import as_column, ratio_or_null
from stockweave.plans.calibrate import profiles_of
from stockweave.sources import versions

CELLS = ("_weekday", "days", "active_days", "units", "squares")


def month_cells(grid: DataFrame, entities: Sequence[str], time: str = "date", value: str = "quantity") -> DataFrame:
    """``period`` (first day of the month) and cells of every series and month of a gap-free daily table."""
    marked = grid.withColumn("period", F.trunc(time, "month"))
    first = F.min(F.when(F.col(value) > 0, F.col(time))).over(W.partitionBy(*entities, "period"))
    y = F.col(value).cast("double")
    return marked.withColumn("_first", first).groupBy("period", *entities, F.weekday(time).alias("_weekday")).agg(
        F.count(value).alias("days"), F.count_if(F.col(time) >= F.col("_first")).alias("active_days"), F.coalesce(F.sum(y), F.lit(0.0)).alias("units"),
        F.coalesce(F.sum(y * y), F.lit(0.0)).alias("squares"),
    )


def window_cells(cells: DataFrame, entities: Sequence[str], start: object) -> DataFrame:
    """Cells per series, weekday and month of the year of the months from ``start`` on, as calibration takes them."""
    sold = F.min(F.when(F.col("active_days") > 0, F.col("period"))).over(W.partitionBy(*entities))
    n = F.when(F.col("period") > F.col("_sold"), F.col("days")).when(F.col("period") == F.col("_sold"), F.col("active_days")).otherwise(F.lit(0))
    kept = cells.withColumn("_sold", sold).withColumn("_days", n).where(F.col("period") >= F.trunc(as_column(start).cast("date"), "month"))
    return kept.groupBy(*entities, "_weekday", F.month("period").alias("_month")).agg(
        F.sum("_days").alias("_n"), F.sum("units").alias("_s"), F.sum("squares").alias("_ss")
    )


def profiles_from_cells(cells: DataFrame, entities: Sequence[str], start: object) -> DataFrame:
    """One profile per series, as ``calibrate_profiles`` from the first day of ``start``'s month on."""
    return profiles_of(window_cells(cells, entities, start), entities)


def add_months(grid: DataFrame, root: str, entities: Sequence[str], time: str = "date", value: str = "quantity") -> versions.Version:
    """Store the cells of the months that ``grid`` holds; stored months it does not hold are neither read nor written."""
    cells, spark = month_cells(grid, entities, time, value), grid.sparkSession
    return versions.publish(cells, root, "period") if versions.version(spark, root) is None else versions.replace_part(cells, root)


# --- accuracy -----------------------------------------------------------------------------------


def accuracy_sums(forecasts: DataFrame, *by: str) -> DataFrame:
    """Rows with an actual, and sums of actuals, errors, absolute and squared errors."""
    error = F.col("forecast") - F.col("actual")
    names = {"rows": F.lit(1).cast("bigint"), "actuals": F.col("actual"), "errors": error, "absolute": F.abs(error), "squared": error * error}
    known = forecasts.where(F.col("actual").isNotNull())
    return known.groupBy(*by).agg(*[F.sum(c).alias(n) for n, c in names.items()])


def merged_accuracy(sums: DataFrame, *by: str) -> DataFrame:
    """The accuracy columns of any grouping of stored sums."""
    total: dict[str, Column] = {n: F.sum(n) for n in ("rows", "actuals", "errors", "absolute", "squared")}
    measures = [
        F.coalesce(total["rows"], F.lit(0)).cast("bigint").alias("forecast_rows_evaluated"), (total["absolute"] / total["rows"]).alias("mae"),
        F.sqrt(total["squared"] / total["rows"]).alias("rmse"), ratio_or_null(total["absolute"], total["actuals"]).alias("wape"), ratio_or_null(total["errors"], total["actuals"]).alias("bias"),
    ]
    return sums.groupBy(*by).agg(*measures) if by else sums.agg(*measures)
