"""Queries of section C (joins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions.numeric import stable6
from stockweave.functions.random import hash48
from stockweave.operators import aggregates as A
from stockweave.operators import joins as J
from stockweave.operators import spine
from stockweave.plans import calibrate
from stockweave.plans import planning as P
from stockweave.queries import inputs as I
from stockweave.queries.forecasting import backtest_of, forecast_of
from stockweave.queries.inputs import ENTITIES
from stockweave.queries.registry import query
from stockweave.queries.sqlparts import define, even, hash48 as sql_hash48, r6, with_ctes


def product_suppliers(t):
    """Each product's supplier, picked by a hash of the product."""
    count = t.raw("supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    return t.raw("part").select(F.col("p_type").alias("product_id")).distinct().withColumn("supplier_id", F.pmod(hash48(F.col("product_id")), count))


def warehouses(t):
    return t.raw("region").select(
        F.concat(F.lit("WH"), F.lpad((F.col("r_regionkey") + 1).cast("string"), 2, "0")).alias("warehouse_id"), F.col("r_name").alias("store_id")
    )


define("product_supplier", f"SELECT DISTINCT p_type AS product_id, {sql_hash48('p_type')} % (SELECT count(*) FROM supplier) AS supplier_id FROM part")
define("warehouse", "SELECT 'WH' || lpad(CAST(r_regionkey + 1 AS VARCHAR), 2, '0') AS warehouse_id, r_name AS store_id FROM region")


def mean_daily(t):
    return A.mean_daily_demand(I.sales_grid(t), 365, I.scalar(t.ship_bounds, "hi"))


@query(
    "join_planning_inputs",
    with_ctes("mean_daily product_supplier warehouse lead", "SELECT product_id, store_id, warehouse_id, supplier_id, mean_daily_demand, lead_time_mean_days FROM mean_daily JOIN warehouse USING (store_id) JOIN product_supplier USING (product_id) JOIN lead USING (supplier_id)"),
)
def join_planning_inputs(t):
    demand = J.many_to_one(mean_daily(t), warehouses(t), ["store_id"])
    sourced = J.many_to_one(demand, product_suppliers(t), ["product_id"])
    timed = J.many_to_one(sourced, t.lead_times.select("supplier_id", "lead_time_mean_days"), ["supplier_id"])
    return timed.select("product_id", "store_id", "warehouse_id", "supplier_id", "mean_daily_demand", "lead_time_mean_days")


@query(
    "join_left_m1_checked",
    with_ctes("sales price", f""", costs AS (SELECT product_id, {even('avg(unit_price)', 4)} AS avg_unit_price FROM price GROUP BY ALL)
SELECT date, product_id, store_id, quantity, avg_unit_price FROM sales LEFT JOIN costs USING (product_id)"""),
)
def join_left_m1_checked(t):
    joined = J.many_to_one(t.sales, A.mean_price(t.price), ["product_id"], "left")
    return J.require_values(joined, ["avg_unit_price"], "price missing").select("date", "product_id", "store_id", "quantity", "avg_unit_price")


@query("join_left_actuals", with_ctes("bt_seasonal_naive", f"SELECT origin_date, date, product_id, store_id, {r6('forecast')} AS forecast, actual FROM bt_seasonal_naive"))
def join_left_actuals(t):
    return backtest_of(t, "seasonal_naive").withColumn("forecast", stable6(F.col("forecast")))


RECENT = "date > (SELECT hi - 7 FROM bounds)"


@query("semi_join_series", with_ctes("sales bounds", f"SELECT date, product_id, store_id, quantity FROM sales s WHERE EXISTS (SELECT 1 FROM sales r WHERE r.product_id = s.product_id AND r.store_id = s.store_id AND r.{RECENT} AND r.quantity > 60)"))
def semi_join_series(t):
    recent = t.sales.where((F.col("date") > F.date_sub(I.scalar(t.ship_bounds, "hi"), 7)) & (F.col("quantity") > 60))
    return J.semi_join_series(t.sales, recent, ENTITIES).select("date", *ENTITIES, "quantity")


@query(
    "anti_join_orphans",
    """SELECT relation, CAST(sum(n) AS BIGINT) AS orphan_rows, CAST(count(*) FILTER (n > 0) AS BIGINT) AS orphan_keys FROM (
    SELECT 'lineitem->orders' AS relation, 0 AS n UNION ALL SELECT 'events->customer', 0 UNION ALL SELECT 'documents->labels', 0
    UNION ALL SELECT 'lineitem->orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
    UNION ALL SELECT 'events->customer', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id
    UNION ALL SELECT 'documents->labels', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id) GROUP BY ALL""",
)
def anti_join_orphans(t):
    relations = {
        "lineitem->orders": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        "events->customer": ("events", "user_id", "customer", "c_custkey"),
        "documents->labels": ("documents", "doc_id", "labels", "doc_id"),
    }
    result = None
    for name, (child, field, parent, ref) in relations.items():
        orphans = J.orphan_keys(t.raw(child), [field], t.raw(parent), [ref])
        part = orphans.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys")).select(F.lit(name).alias("relation"), "orphan_rows", "orphan_keys")
        result = part if result is None else result.unionByName(part)
    return result


@query("lookup_map", with_ctes("po lead", "SELECT po_id, supplier_id, lead_time_mean_days, on_time_probability, CASE warehouse_id WHEN 'ASIA' THEN 'east' WHEN 'EUROPE' THEN 'west' ELSE 'other' END AS zone FROM po JOIN lead USING (supplier_id)"))
def lookup_map(t):
    from stockweave.plans.synth import lookup_value

    leads = t.lead_times.select("supplier_id", "lead_time_mean_days", "on_time_probability")
    zone = lookup_value(F.col("warehouse_id"), {"ASIA": "east", "EUROPE": "west"}, "other")
    return t.purchase_orders.join(t.held("supplier", leads), "supplier_id").select("po_id", "supplier_id", "lead_time_mean_days", "on_time_probability", zone.alias("zone"))


@query(
    "asof_latest_origin",
    with_ctes("sales origins", "SELECT s.*, (SELECT max(origin_date) FROM origins WHERE origin_date <= s.date) AS origin_date FROM sales s"),
)
def asof_latest_origin(t):
    known = forecast_of(t, "moving_average").select(*ENTITIES, "origin_date").distinct()
    return J.asof_latest(t.sales, known, ENTITIES, "date", "origin_date").select("date", *ENTITIES, "quantity", "origin_date")


def recent_days(t):
    """Every series on every day of the last 91 days."""
    hi = I.scalar(t.ship_bounds, "hi")
    return t.sales.select(*ENTITIES).distinct().select(*ENTITIES, F.explode(spine.date_sequence(F.date_sub(hi, 90), hi)).alias("day"))


define("recent_days", "SELECT product_id, store_id, date AS day FROM entities CROSS JOIN calendar WHERE date >= (SELECT hi - 90 FROM bounds)", "entities", "calendar", "bounds")
define(
    "asof_days",
    "SELECT product_id, store_id, day, (SELECT max(origin_date) FROM origins WHERE origin_date <= d.day) AS origin_date FROM recent_days d",
    "recent_days", "origins",
)


@query(
    "forecast_total_ahead",
    with_ctes("asof_days fc_seasonal_naive", f"""SELECT a.product_id, a.store_id, a.day, a.origin_date, CAST(count(f.date) AS BIGINT) AS covered_days,
    CASE WHEN count(f.date) >= 25 THEN {r6('sum(f.forecast)')} END AS total FROM asof_days a LEFT JOIN fc_seasonal_naive f
    ON f.product_id = a.product_id AND f.store_id = a.store_id AND f.origin_date = a.origin_date AND f.date >= a.day AND f.date < a.day + 25 GROUP BY ALL"""),
)
def forecast_total_ahead(t):
    totals = P.forecast_total_ahead(recent_days(t), forecast_of(t, "seasonal_naive"), ENTITIES, 25)
    return totals.select(*ENTITIES, "day", "origin_date", "covered_days", stable6(F.col("total")).alias("total"))


define(
    "in_use",
    """SELECT product_id, store_id, date, origin_date, forecast, actual, forecast - actual AS error FROM bt_seasonal_naive
WHERE actual IS NOT NULL AND origin_date <= date QUALIFY row_number() OVER (PARTITION BY product_id, store_id, date ORDER BY origin_date DESC) = 1""",
    "bt_seasonal_naive",
)


@query(
    "forecast_errors_in_use",
    with_ctes("in_use recent_days", f"""SELECT d.product_id, d.store_id, d.day, e.date, {r6('e.forecast')} AS forecast, e.actual, {r6('e.error')} AS error
    FROM recent_days d JOIN in_use e ON e.product_id = d.product_id AND e.store_id = d.store_id AND e.date >= d.day - 14 AND e.date < d.day"""),
)
def forecast_errors_in_use(t):
    errors = P.errors_in_use(backtest_of(t, "seasonal_naive"), ENTITIES)
    pairs = P.errors_before(recent_days(t), errors, ENTITIES, 14)
    return pairs.select(*ENTITIES, "day", "date", stable6(F.col("forecast")).alias("forecast"), "actual", stable6(F.col("error")).alias("error"))


@query(
    "cross_join_profiles_dates",
    with_ctes("mean_daily bounds", """SELECT product_id, store_id, CAST(d AS BIGINT) AS day_index, CAST(hi + 1 + CAST(d AS INTEGER) AS DATE) AS date, mean_daily_demand AS level
    FROM mean_daily CROSS JOIN bounds CROSS JOIN (SELECT unnest(generate_series(0, 90)) AS d)"""),
)
def cross_join_profiles_dates(t):
    start = F.date_add(I.scalar(t.ship_bounds, "hi"), 1)
    return calibrate.profile_days(mean_daily(t), start, 91).select(*ENTITIES, "day_index", "date", F.col("mean_daily_demand").alias("level"))


@query(
    "reindex_to_spine",
    with_ctes("grid", "SELECT product_id, store_id, CAST(count(*) AS BIGINT) AS days, CAST(count(*) FILTER (NOT observed) AS BIGINT) AS missing_cells, CAST(sum(quantity) AS BIGINT) AS units FROM grid GROUP BY ALL"),
)
def reindex_to_spine(t):
    cells = spine.reindex_to_spine(t.sales, "date", ENTITIES, "quantity", t.ship_bounds)
    return cells.groupBy(*ENTITIES).agg(F.count(F.lit(1)).alias("days"), F.count_if(~F.col("observed")).alias("missing_cells"), F.sum(F.coalesce("quantity", F.lit(0))).alias("units"))


@query(
    "seasonal_lag_join",
    with_ctes("grid entities bounds", """SELECT t.product_id, t.store_id, t.date, CAST(t.k AS BIGINT) AS k, t.source_date, g.quantity FROM (
    SELECT product_id, store_id, CAST(hi + h AS DATE) AS date, k, CAST(hi + h - CAST(7 * (ceil(h / 7.0) + k) AS INTEGER) AS DATE) AS source_date
    FROM entities CROSS JOIN bounds CROSS JOIN (SELECT CAST(unnest(generate_series(1, 28)) AS INTEGER) AS h) CROSS JOIN (SELECT unnest(generate_series(0, 3)) AS k)) t
    JOIN grid g ON g.product_id = t.product_id AND g.store_id = t.store_id AND g.date = t.source_date"""),
)
def seasonal_lag_join(t):
    hi = I.scalar(t.ship_bounds, "hi")
    grid = I.sales_grid(t)
    targets = grid.select(*ENTITIES).distinct().select(*ENTITIES, F.explode(F.sequence(F.lit(1), F.lit(28))).alias("h"))
    picks = targets.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    back = 7 * (F.ceil(F.col("h") / 7.0) + F.col("k"))
    dated = picks.withColumns({"date": F.date_add(hi, F.col("h")), "source_date": F.date_add(hi, (F.col("h") - back).cast("int"))})
    source = grid.select(*ENTITIES, F.col("date").alias("source_date"), "quantity")
    return dated.join(source, [*ENTITIES, "source_date"]).select(*ENTITIES, "date", F.col("k").cast("bigint").alias("k"), "source_date", "quantity")


@query(
    "history_theta_join",
    with_ctes("grid origins", "SELECT origin_date, product_id, store_id, CAST(count(*) AS BIGINT) AS observations, CAST(sum(quantity) AS BIGINT) AS units FROM origins JOIN grid ON date < origin_date GROUP BY ALL"),
)
def history_theta_join(t):
    from pyspark.sql import Window as W

    upto = W.partitionBy(*ENTITIES).orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = I.sales_grid(t).select("date", *ENTITIES, F.count(F.lit(1)).over(upto).alias("observations"), F.sum("quantity").over(upto).alias("units"))
    origins = spine.origin_spine(t.ship_bounds, F.date_sub("hi", 90), F.col("hi"), 7)
    keyed = origins.withColumn("date", F.date_sub("origin_date", 1))
    return running.join(keyed, "date").select("origin_date", *ENTITIES, "observations", "units")


@query(
    "keyset_compare",
    """SELECT coalesce(c, u) AS key, CASE WHEN u IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM
       (SELECT c_custkey AS c FROM customer) FULL OUTER JOIN (SELECT DISTINCT user_id * 7 AS u FROM events) ON c = u WHERE c IS NULL OR u IS NULL""",
)
def keyset_compare(t):
    expected = t.raw("customer").select(F.col("c_custkey").alias("key"))
    found = t.raw("events").select((F.col("user_id") * 7).alias("key"))
    return J.keyset_compare(expected, found, ["key"])
