"""Replenishment levels, order sizing and purchase orders, all in closed form per item and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockweave.functions import calendar as C
from stockweave.functions.numeric import as_column, ceil_to_multiple, normal_quantile
from stockweave.functions.random import seeded_normal, seeded_uniform, uniform_integer
from stockweave.operators.joins import asof_latest
from stockweave.operators.windows import latest_origin_per_date


def forecast_total_ahead(days: DataFrame, forecasts: DataFrame, entities: Sequence[str], days_ahead: object, at: str = "day") -> DataFrame:
    """Sum of the forecast over ``[at, at + days_ahead)`` from the latest origin <= ``at``.

    Adds ``origin_date``, ``covered_days`` and ``total`` (null when the forecast does not cover the
    whole span). An origin's forecast is one array bounded by its horizon.
    """
    curve = forecasts.groupBy(*entities, "origin_date").agg(F.array_sort(F.collect_list(F.struct("date", "forecast"))).alias("_curve"))
    located = asof_latest(days, curve.select(*entities, "origin_date"), entities, at, "origin_date")
    joined = located.join(curve, [*entities, "origin_date"], "left")
    n = as_column(days_ahead).cast("int")
    start = F.col(at)
    span = F.filter("_curve", lambda x: (x["date"] >= start) & (x["date"] < F.date_add(start, n)))
    total = F.aggregate(span, F.lit(0.0), lambda s, x: s + x["forecast"])
    covered = F.coalesce(F.size(span), F.lit(0)).cast("bigint")
    summed = joined.withColumns({"covered_days": F.when(F.col("_curve").isNull(), F.lit(0).cast("bigint")).otherwise(covered), "total": total})
    return summed.withColumn("total", F.when(F.col("covered_days") >= n, F.col("total"))).drop("_curve")


def errors_in_use(forecasts: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Forecast minus actual per (entity, date) from the latest origin <= date."""
    used = latest_origin_per_date(forecasts.where(F.col("actual").isNotNull()), entities)
    return used.withColumn("error", F.col("forecast") - F.col("actual"))


def errors_before(days: DataFrame, errors: DataFrame, entities: Sequence[str], window_days: int, at: str = "day") -> DataFrame:
    """Error rows dated in ``[at - window, at)`` for each (entity, day) of ``days``.

    Each error names the days that can see it, so the pairing is an equi-join.
    """
    seen = errors.select(*entities, "date", "forecast", "actual", "error",
                         F.explode(F.sequence(F.date_add("date", 1), F.date_add("date", window_days), F.expr("interval 1 day"))).alias(at))
    return days.select(*entities, at).join(seen, [*entities, at])


def error_std(days: DataFrame, errors: DataFrame, entities: Sequence[str], window_days: int, at: str = "day") -> DataFrame:
    """Sample standard deviation of the errors in ``[at - window, at)``; null below two errors."""
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    rows = errors.select(*entities, F.col("date").alias(at), "error", F.lit(False).alias("_ask")).unionByName(
        days.select(*entities, at).distinct().select(*entities, at, F.lit(None).cast("double").alias("error"), F.lit(True).alias("_ask"))
    )
    before = W.partitionBy(*entities).orderBy(number(F.col(at))).rangeBetween(-window_days, -1)
    stats = rows.withColumns({"errors": F.count("error").over(before), "_std": F.stddev_samp("error").over(before)})
    asked = stats.where("_ask").select(*entities, at, "errors", F.when(F.col("errors") >= 2, F.col("_std")).alias("error_std"))
    return days.join(asked, [*entities, at], "left")


def _forecast_rate(days: DataFrame, forecasts: DataFrame, entities: Sequence[str], cover: Column) -> DataFrame:
    """Mean daily forecast over the ``max(1, ceil(cover))`` days after each day."""
    n = F.greatest(F.ceil(cover).cast("int"), F.lit(1))
    tomorrow = days.withColumns({"_n": n, "_tomorrow": F.date_add("day", 1)})
    total = forecast_total_ahead(tomorrow, forecasts, entities, F.col("_n"), "_tomorrow")
    return total.withColumn("rate", F.col("total") / F.col("_n")).drop("_n", "_tomorrow", "total", "covered_days", "origin_date")


def reorder_point_levels(means: DataFrame, items: DataFrame, entities: Sequence[str]) -> DataFrame:
    """s = mean * lead, Q = mean * cycle; 0 without history. ``items``: lead and cycle per item."""
    joined = items.join(means, list(entities), "left")
    mean = F.coalesce("mean_demand", F.lit(0.0))
    return joined.withColumns({"reorder_point": mean * F.col("lead_time_mean_days"), "order_quantity": mean * F.col("order_cycle_days")})


def safety_stock_levels(days: DataFrame, forecasts: DataFrame, entities: Sequence[str], error_window_days: int = 56) -> DataFrame:
    """SS = z * sigma * sqrt(L); s = rate * L + SS; S = s + rate * R, for each (item, day).

    ``days`` carries lead_time_mean_days, order_cycle_days and target_service_level.
    """
    lead, cycle = F.col("lead_time_mean_days"), F.col("order_cycle_days")
    rated = _forecast_rate(days, forecasts, entities, lead + cycle)
    spread = error_std(rated, errors_in_use(forecasts, entities), entities, error_window_days)
    safety = normal_quantile(F.col("target_service_level")) * F.col("error_std") * F.sqrt(lead)
    with_stock = spread.withColumn("safety_stock", safety)
    with_point = with_stock.withColumn("reorder_point", F.col("rate") * lead + F.col("safety_stock"))
    return with_point.withColumn("order_up_to", F.col("reorder_point") + F.col("rate") * cycle)


def order_up_to_levels(days: DataFrame, forecasts: DataFrame, entities: Sequence[str], error_window_days: int = 56) -> DataFrame:
    """S = rate * (L + R) + z * sigma * sqrt(L + R) for each (item, review day)."""
    cover = F.col("lead_time_mean_days") + F.col("order_cycle_days")
    rated = _forecast_rate(days, forecasts, entities, cover)
    spread = error_std(rated, errors_in_use(forecasts, entities), entities, error_window_days)
    level = F.col("rate") * cover + normal_quantile(F.col("target_service_level")) * F.col("error_std") * F.sqrt(cover)
    return spread.withColumn("order_up_to", level)


def recommend_fixed_quantity(position: Column, reorder_point: Column, quantity: Column) -> Column:
    return F.when(position <= reorder_point, quantity).otherwise(F.lit(0.0))


def recommend_up_to_when_low(position: Column, reorder_point: Column, order_up_to: Column) -> Column:
    return F.when(position <= reorder_point, order_up_to - position).otherwise(F.lit(0.0))


def recommend_up_to(position: Column, order_up_to: Column) -> Column:
    return F.greatest(F.lit(0.0), order_up_to - position)


def rounded_order(raw: Column, min_order_qty: Column, case_pack: Column) -> Column:
    """0 for nothing to order; else at least the minimum, rounded up to whole case packs."""
    return F.when(raw <= 0, F.lit(0).cast("bigint")).otherwise(ceil_to_multiple(F.greatest(raw.cast("double"), min_order_qty.cast("double")), case_pack))


def planner_lead_time(lead: Column, lead_time_delta: object, planner_aware: object) -> Column:
    return lead + F.when(as_column(planner_aware), as_column(lead_time_delta)).otherwise(F.lit(0))


def order_lead_time(orders: DataFrame, seed: int, in_window: Column, lead_time_delta: int, max_extra_delay: int = 3, key: str = "po_id") -> DataFrame:
    """Lead time of each purchase order: noisy mean, scenario delta in the window, extra delay when late.

    All draws come from the order key, so a scenario changes only what its parameters change.
    """
    z = seeded_normal(seed, "lead_time", F.col(key))
    late = seeded_uniform(seed, "late", F.col(key)) >= F.col("on_time_probability")
    delay = uniform_integer(seeded_uniform(seed, "delay", F.col(key)), 1, max_extra_delay)
    delta = F.when(in_window, F.lit(lead_time_delta)).otherwise(F.lit(0))
    base = F.greatest(F.lit(1).cast("bigint"), F.rint(F.col("lead_time_mean_days") + delta + F.col("lead_time_std_days") * z).cast("bigint"))
    lead = base + F.when(late, delay).otherwise(F.lit(0))
    dated = orders.withColumn("sampled_lead_time_days", lead)
    return dated.withColumn("expected_arrival_date", F.date_add("order_date", F.col("sampled_lead_time_days").cast("int")))


def shipped_quantity(quantity: Column, in_window: Column, capacity_factor: float) -> Column:
    """Inside the window suppliers ship the given share, rounded up; the rest is lost."""
    return F.when(in_window, F.ceil(quantity * F.lit(float(capacity_factor)))).otherwise(quantity).cast("bigint")


def order_status(orders: DataFrame, horizon_end: object) -> DataFrame:
    """Status and received date; arrivals after the last horizon day are still open."""
    arrival = F.col("expected_arrival_date")
    status = (
        F.when(F.col("shipped_qty") == 0, "not_shipped")
        .when(arrival > as_column(horizon_end), "open")
        .when(F.col("shipped_qty") < F.col("quantity"), "partially_received")
        .otherwise("received")
    )
    tagged = orders.withColumn("status", status)
    return tagged.withColumn("received_date", F.when(F.col("status").isin("received", "partially_received"), arrival))


def receipts_by_day(orders: DataFrame, horizon_end: object, item: Sequence[str] = ("product_id", "warehouse_id")) -> DataFrame:
    arrived = orders.where((F.col("expected_arrival_date") <= as_column(horizon_end)) & (F.col("shipped_qty") > 0))
    return arrived.groupBy(*item, F.col("expected_arrival_date").alias("date")).agg(F.sum("shipped_qty").alias("arrivals"))


def po_text(product: Column, warehouse: Column, day_index: Column) -> Column:
    """Order id from its item and order day."""
    return F.concat_ws(".", product, warehouse, F.format_string("d%04d", day_index))


def disruption_effect(orders: DataFrame, in_window: str = "in_window") -> DataFrame:
    """Mean lead time and shipped share inside and outside the window."""
    return orders.groupBy(in_window).agg(
        F.count(F.lit(1)).alias("orders"),
        (F.sum("sampled_lead_time_days") / F.count(F.lit(1))).alias("mean_lead_time"),
        (F.sum("shipped_qty") / F.sum("quantity")).alias("shipped_share"),
    )


def review_days(days: DataFrame, start: object, review_period: int, cycle: int, time: str = "date") -> DataFrame:
    """Flags review days (every ``review_period`` days) and next-order days (every ``cycle`` days)."""
    index = C.day_index(F.col(time), start)
    return days.withColumns({"day_index": index, "is_review": (index % review_period) == 0, "is_order_day": (index % cycle) == 0})


def invalid_forecasts(forecasts: DataFrame, by: Sequence[str] = (), value: str = "forecast") -> DataFrame:
    """NaN, infinite and negative forecast values, counted."""
    v = F.col(value).cast("double")
    infinite = v.isin(float("inf"), float("-inf"))
    return forecasts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.isnan(v) | v.isNull()).alias("nan_values"), F.count_if(infinite).alias("infinite_values"),
        F.count_if((v < 0) & ~F.isnan(v) & ~infinite).alias("negative_values"),
    )
