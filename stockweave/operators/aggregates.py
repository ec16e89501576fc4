"""Aggregates over demand history and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.functions.calendar import weekday_monday0
from stockweave.functions.numeric import as_column, ratio_or_null, round_half_even


def mean_price(prices: DataFrame) -> DataFrame:
    """Mean unit price per product, four decimals."""
    return prices.groupBy("product_id").agg(round_half_even(F.avg("unit_price"), 4).alias("avg_unit_price"))


def priced_items(prices: DataFrame) -> DataFrame:
    """Every (product, store) with a price, and its product's mean unit price: sums per item, then over the few items of a product."""
    items = prices.groupBy("product_id", "store_id").agg(F.sum("unit_price").alias("_sum"), F.count("unit_price").alias("_n"))
    of = W.partitionBy("product_id")
    return items.select("product_id", "store_id", round_half_even(F.sum("_sum").over(of) / F.sum("_n").over(of), 4).alias("avg_unit_price"))


def store_demand(demand: DataFrame) -> DataFrame:
    return demand.groupBy("store_id").agg(F.sum("mean_daily_demand").alias("mean_daily_demand"))


def active_rows(sales: DataFrame, entities: Sequence[str], time: str, value: str, window_start: Column) -> DataFrame:
    """Rows from the later of the first sale and the window start; adds ``_sold`` (ever sold).

    Sales have one row per day and series, so an entity's window is bounded by the calendar.
    """
    entity = W.partitionBy(*entities)
    first = F.min(F.when(F.col(value) > 0, F.col(time))).over(entity)
    marked = sales.withColumn("_first", first)
    return marked.withColumn("_active", (F.col(time) >= F.greatest(F.col("_first"), window_start)) & F.col("_first").isNotNull())


def _mean_of_active(marked: DataFrame, entities: Sequence[str], value: str, name: str) -> DataFrame:
    mean = F.avg(F.when(F.col("_active"), F.col(value)))
    return marked.groupBy(*entities).agg(F.coalesce(mean, F.lit(0.0)).alias(name))


def mean_daily_demand(sales: DataFrame, window_days: int, end: object, entities: Sequence[str] = ("product_id", "store_id"),
                      time: str = "date", value: str = "quantity") -> DataFrame:
    """Mean units per day over the last days of active history, six decimals; 0 when never sold.

    The window ends on the last day of the whole table (``end``).
    """
    marked = active_rows(sales, entities, time, value, F.date_sub(as_column(end), window_days - 1))
    means = _mean_of_active(marked, entities, value, "mean_daily_demand")
    return means.withColumn("mean_daily_demand", round_half_even(F.col("mean_daily_demand"), 6))


def active_history_mean(sales: DataFrame, window_days: int, entities: Sequence[str] = ("product_id", "store_id"),
                        time: str = "date", value: str = "quantity") -> DataFrame:
    """As ``mean_daily_demand`` but the window ends on each series' own last day; not rounded."""
    last = F.max(time).over(W.partitionBy(*entities))
    marked = active_rows(sales.withColumn("_last", last), entities, time, value, F.date_sub(F.col("_last"), window_days - 1))
    return _mean_of_active(marked, entities, value, "mean_demand")


def entity_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact distinct values per entity key, one row per key."""
    counts = df.agg(*[F.countDistinct(k).alias(k) for k in keys])
    return counts.unpivot([], list(keys), "entity_key", "distinct_values")


def time_range(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("range_start"), F.max(time).alias("range_end"))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, nulls, range and mean, from one aggregate over the table; NaN counts as missing."""
    from stockweave.operators.quality import nan_as_missing

    df = nan_as_missing(df)
    aggregates, rows = [], []
    for f in df.schema.fields:
        c, name = F.col(f"`{f.name}`"), f.name
        number = isinstance(f.dataType, T.NumericType)
        dated = isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        aggregates.append(F.count_if(c.isNull()).alias(f"{name}#nulls"))
        if number or dated:
            aggregates += [F.min(c).alias(f"{name}#min"), F.max(c).alias(f"{name}#max")]
        if number:
            aggregates.append(F.avg(c).alias(f"{name}#mean"))

        def pick(part: str, kind: str, present: bool, name: str = name) -> Column:
            return F.col(f"`{name}#{part}`").cast(kind) if present else F.lit(None).cast(kind)

        rows.append(F.struct(
            F.lit(name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"`{name}#nulls`").alias("null_count"),
            pick("min", "double", number).alias("min_number"), pick("max", "double", number).alias("max_number"),
            pick("min", "string", dated).alias("min_date"), pick("max", "string", dated).alias("max_date"),
            pick("mean", "double", number).alias("mean"),
        ))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def series_sum_by_date(df: DataFrame, time: str, value: str) -> DataFrame:
    return df.groupBy(time).agg(F.sum(value).alias(value)).orderBy(time)


def demand_stats(grid: DataFrame, entities: Sequence[str], time: str = "date", value: str = "quantity") -> DataFrame:
    """Series, days, means, variability of daily totals and share of zero days."""
    v = F.col(value)
    daily = grid.groupBy(time).agg(
        F.sum(v).alias("total"), F.count(F.lit(1)).alias("cells"), F.count_if(v > 0).alias("selling"), F.count_if(v == 0).alias("zeros")
    )
    series = grid.agg(F.countDistinct(*entities).alias("series"))
    totals = daily.agg(
        F.count(F.lit(1)).alias("days"),
        ratio_or_null(F.sum("total"), F.sum("cells")).alias("mean_units"),
        ratio_or_null(F.sum("total"), F.sum("selling")).alias("mean_selling_day"),
        (F.stddev_samp("total") / F.avg("total")).alias("cv_daily_total"),
        ratio_or_null(F.sum("zeros"), F.sum("cells")).alias("zero_share"),
    )
    return totals.withColumn("series", series.scalar())


def weekday_index(grid: DataFrame, time: str = "date", value: str = "quantity", decimals: int = 3) -> DataFrame:
    """Mean of each weekday over the overall mean, Monday = 0."""
    sums = grid.groupBy(weekday_monday0(F.col(time)).alias("weekday")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    overall = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # seven rows
    mean = F.sum("s").over(overall) / F.sum("n").over(overall)
    return sums.select("weekday", round_half_even(F.col("s") / F.col("n") / mean, decimals).alias("weekday_index"))


def item_mean_correlation(left: DataFrame, right: DataFrame, item: str, value: str) -> DataFrame:
    a = left.groupBy(item).agg(F.avg(value).alias("a"))
    b = right.groupBy(item).agg(F.avg(value).alias("b"))
    return a.join(b, item).agg(F.corr("a", "b").alias("correlation"), F.count(F.lit(1)).alias("items"))
