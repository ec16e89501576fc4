"""Queries of section P (levels and order sizing)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockweave.functions.numeric import normal_quantile, stable6
from stockweave.functions.random import hash48
from stockweave.operators import aggregates as A
from stockweave.plans import planning as P
from stockweave.queries import inputs as I
from stockweave.queries import ledger as QL
from stockweave.queries.forecasting import SPEC, backtest_of, origin_range
from stockweave.queries.inputs import ENTITIES
from stockweave.queries.registry import query
from stockweave.queries.sqlparts import define, hash48 as sql_hash48, r6, with_ctes
from stockweave.functions import numeric as N


def quantile_sql(p: str) -> str:
    """The normal quantile approximation in SQL."""

    def horner(coefficients, x, tail=None):
        total = repr(coefficients[0])
        for c in (*coefficients[1:], *(() if tail is None else (tail,))):
            total = f"({total} * {x} + {c!r})"
        return total

    q = f"({p} - 0.5::DOUBLE)"
    s, low, high = f"({q} * {q})", f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))"
    return f"""CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {N.QUANTILE_TAIL} THEN {horner(N.QUANTILE_C, low)} / {horner(N.QUANTILE_D, low, 1.0)}
 WHEN {p} > {1 - N.QUANTILE_TAIL} THEN -{horner(N.QUANTILE_C, high)} / {horner(N.QUANTILE_D, high, 1.0)}
 ELSE {horner(N.QUANTILE_A, s)} * {q} / {horner(N.QUANTILE_B, s, 1.0)} END"""


@query(
    "levels_reorder_point",
    with_ctes("lead_items history_mean", f"SELECT product_id, store_id, {r6('mean_demand * lead_time_mean_days')} AS reorder_point, {r6('mean_demand * order_cycle_days')} AS order_quantity FROM lead_items JOIN history_mean USING (product_id, store_id)"),
)
def levels_reorder_point(t):
    levels = P.reorder_point_levels(A.active_history_mean(t.sales, 365), I.lead_items(t), ENTITIES)
    return levels.select(*ENTITIES, *[stable6(F.col(c)).alias(c) for c in ("reorder_point", "order_quantity")])


def planning_days(t, *offsets: int):
    """Items on the planning days ``hi - offset``."""
    hi = I.scalar(t.ship_bounds, "hi")
    days = F.array(*[F.date_sub(hi, o) for o in offsets])
    return I.lead_items(t).select("*", F.explode(days).alias("day"))


def review_items(t):
    """Items on the day before every weekly forecast origin."""
    origins = origin_range(t)
    spread = I.lead_items(t).select("*", F.explode(F.sequence(origins.start, origins.end, F.expr(f"interval {SPEC.interval_days} day"))).alias("_origin"))
    return spread.withColumn("day", F.date_sub("_origin", 1)).drop("_origin")


# Cover n days ahead from tomorrow; z, rate and error spread per item and planning day.
define(
    "level_inputs",
    f"""
SELECT d.*, {quantile_sql('target_service_level')} AS z,
  (SELECT sum(f.forecast) FROM fc_seasonal_naive f WHERE f.product_id = d.product_id AND f.store_id = d.store_id
     AND f.origin_date = (SELECT max(origin_date) FROM origins WHERE origin_date <= d.day + 1) AND f.date > d.day AND f.date <= d.day + d.n) / d.n AS rate,
  (SELECT stddev_samp(e.error) FROM in_use e WHERE e.product_id = d.product_id AND e.store_id = d.store_id AND e.date >= d.day - 56 AND e.date < d.day) AS error_std
FROM (SELECT *, CAST(greatest(1, ceil(lead_time_mean_days + order_cycle_days)) AS INTEGER) AS n, CAST(hi - o AS DATE) AS day
      FROM lead_items CROSS JOIN bounds CROSS JOIN (SELECT CAST(hi - origin_date + 1 AS INTEGER) AS o FROM origins CROSS JOIN bounds) v) d
""",
    "lead_items", "bounds", "fc_seasonal_naive", "origins", "in_use",
)


@query(
    "levels_safety_stock",
    with_ctes("level_inputs", f"""SELECT product_id, store_id, day, {r6('ss')} AS safety_stock, {r6('rate * lead_time_mean_days + ss')} AS reorder_point,
    {r6('rate * lead_time_mean_days + ss + rate * order_cycle_days')} AS order_up_to FROM (SELECT *, z * error_std * sqrt(lead_time_mean_days) AS ss FROM level_inputs WHERE day = (SELECT hi - 28 FROM bounds))"""),
)
def levels_safety_stock(t):
    levels = P.safety_stock_levels(planning_days(t, 28), backtest_of(t, "seasonal_naive"), ENTITIES)
    return levels.select(*ENTITIES, "day", *[stable6(F.col(c)).alias(c) for c in ("safety_stock", "reorder_point", "order_up_to")])


@query(
    "levels_order_up_to",
    with_ctes("level_inputs", f"SELECT product_id, store_id, day, {r6('rate * (lead_time_mean_days + order_cycle_days) + z * error_std * sqrt(lead_time_mean_days + order_cycle_days)')} AS order_up_to FROM level_inputs"),
)
def levels_order_up_to(t):
    levels = P.order_up_to_levels(review_items(t), backtest_of(t, "seasonal_naive"), ENTITIES)
    return levels.select(*ENTITIES, "day", stable6(F.col("order_up_to")).alias("order_up_to"))


# Levels from the whole demand history of an item, met by every ledger day's position.
define(
    "advice_levels",
    """SELECT product_id, warehouse_id, 7.0 * avg(demand) AS s, 14.0 * avg(demand) AS q, 21.0 * avg(demand) AS up_to FROM moves GROUP BY ALL""",
    "moves",
)
define(
    "advice",
    """SELECT date, product_id, warehouse_id, position, CASE WHEN position <= s THEN q ELSE 0.0 END AS fixed_quantity,
CASE WHEN position <= s THEN up_to - position ELSE 0.0 END AS up_to_when_low, greatest(0.0, up_to - position) AS up_to_level
FROM (SELECT date, product_id, warehouse_id, closing_on_hand + on_order AS position FROM positions) JOIN advice_levels USING (product_id, warehouse_id)""",
    "positions", "advice_levels",
)


def advice(t):
    mean = F.avg("demand").over(W.partitionBy(*I.ITEM))  # one row per day and item
    rows = QL.positions(t).select("date", *I.ITEM, F.col("inventory_position").alias("position"), mean.alias("m"))
    rows = rows.withColumns({"s": 7.0 * F.col("m"), "q": 14.0 * F.col("m"), "up_to": 21.0 * F.col("m")})
    position = F.col("position")
    return rows.select(
        "date", *I.ITEM, "position",
        P.recommend_fixed_quantity(position, F.col("s"), F.col("q")).alias("fixed_quantity"),
        P.recommend_up_to_when_low(position, F.col("s"), F.col("up_to")).alias("up_to_when_low"),
        P.recommend_up_to(position, F.col("up_to")).alias("up_to_level"),
    )


_ADVICE = ("fixed_quantity", "up_to_when_low", "up_to_level")


@query("order_recommendation", with_ctes("advice", f"SELECT date, product_id, warehouse_id, position, {', '.join(f'{r6(c)} AS {c}' for c in _ADVICE)} FROM advice"))
def order_recommendation(t):
    return advice(t).select("date", *I.ITEM, "position", *[stable6(F.col(c)).alias(c) for c in _ADVICE])


_MOQ = f"[0, 6, 12][{sql_hash48('product_id')} % 3 + 1]"
_PACK = f"[6, 12, 24][{sql_hash48('warehouse_id')} % 3 + 1]"


@query(
    "order_rounding",
    with_ctes("timed_orders", f"""SELECT po_id, quantity - 5 AS raw, CAST({_MOQ} AS BIGINT) AS min_order_qty, CAST({_PACK} AS BIGINT) AS case_pack,
    CAST(CASE WHEN quantity - 5 <= 0 THEN 0 ELSE ceil(greatest(quantity - 5, {_MOQ}) / CAST({_PACK} AS DOUBLE)) * {_PACK} END AS BIGINT) AS order_qty FROM timed_orders"""),
)
def order_rounding(t):
    def pick(values, key):
        return F.get(F.array(*[F.lit(v).cast("bigint") for v in values]), F.pmod(hash48(F.col(key)), F.lit(3)).cast("int"))

    rows = t.purchase_orders.select("po_id", (F.col("quantity") - 5).alias("raw"), pick((0, 6, 12), "product_id").alias("min_order_qty"), pick((6, 12, 24), "warehouse_id").alias("case_pack"))
    return rows.withColumn("order_qty", P.rounded_order(F.col("raw"), F.col("min_order_qty"), F.col("case_pack")))


@query("planner_lead_time", with_ctes("lead", f"SELECT supplier_id, lead_time_mean_days, {r6('lead_time_mean_days + CASE WHEN supplier_id % 2 = 0 THEN 7 ELSE 0 END')} AS planner_lead_time FROM lead"))
def planner_lead_time(t):
    lead = P.planner_lead_time(F.col("lead_time_mean_days"), 7, F.col("supplier_id") % 2 == 0)
    return t.lead_times.select("supplier_id", "lead_time_mean_days", stable6(lead).alias("planner_lead_time"))


@query(
    "forecast_value_check",
    with_ctes("bt_seasonal_naive", """, marked AS (SELECT origin_date, CASE WHEN actual = 0 THEN CAST('inf' AS DOUBLE) WHEN actual IS NULL THEN CAST('nan' AS DOUBLE) WHEN forecast > actual THEN -forecast ELSE forecast END AS forecast FROM bt_seasonal_naive)
SELECT origin_date, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (isnan(forecast)) AS BIGINT) AS nan_values, CAST(count(*) FILTER (isinf(forecast)) AS BIGINT) AS infinite_values,
CAST(count(*) FILTER (forecast < 0) AS BIGINT) AS negative_values FROM marked GROUP BY ALL"""),
)
def forecast_value_check(t):
    rows = backtest_of(t, "seasonal_naive")
    bad = F.when(F.col("actual") == 0, F.lit(float("inf"))).when(F.col("actual").isNull(), F.lit(float("nan"))).when(F.col("forecast") > F.col("actual"), -F.col("forecast")).otherwise(F.col("forecast"))
    return P.invalid_forecasts(rows.withColumn("forecast", bad), ["origin_date"])


@query("fn_normal_quantile", with_ctes("lead", f"SELECT supplier_id, on_time_probability, {r6(quantile_sql('on_time_probability'))} AS z, {r6(quantile_sql('(on_time_probability / 50.0)'))} AS z_low FROM lead"))
def fn_normal_quantile(t):
    p = F.col("on_time_probability")
    return t.lead_times.select("supplier_id", p, stable6(normal_quantile(p)).alias("z"), stable6(normal_quantile(p / 50.0)).alias("z_low"))
