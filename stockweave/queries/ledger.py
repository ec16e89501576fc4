"""Queries on stock ledgers, purchase orders and KPIs (sections D, E and P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions.calendar import day_index, disruption_flag
from stockweave.functions.numeric import round_half_even_int, stable6
from stockweave.functions.random import seeded_uniform, uniform_between
from stockweave.operators import aggregates as A
from stockweave.operators import ledger as L
from stockweave.plans import kpis as K
from stockweave.plans import planning as P
from stockweave.plans import report as R
from stockweave.queries import inputs as I
from stockweave.queries.inputs import ITEM
from stockweave.queries.registry import query
from stockweave.queries.sqlparts import define, even, normal, r6, uniform, with_ctes
from stockweave.sources.drivertables import SEED

COLUMNS = "date, product_id, warehouse_id, opening_on_hand, arrivals, demand, fulfilled, lost_sales, closing_on_hand"
WINDOW_START, WINDOW_DAYS, DELTA, CAPACITY = 365, 180, 7, 0.5


@query("stock_ledger_rollforward", with_ctes("ledger", f"SELECT {COLUMNS} FROM ledger"))
def stock_ledger_rollforward(t):
    return I.single_ledger(t)


def timed_orders(t):
    """Purchase orders with window flag, lead time, shipped units and status."""
    lo, hi = I.stock_bounds(t)
    orders = t.purchase_orders.join(t.held("supplier", t.lead_times), "supplier_id")
    flagged = orders.withColumn("in_window", disruption_flag(day_index(F.col("order_date"), lo), WINDOW_START, WINDOW_DAYS))
    timed = P.order_lead_time(flagged, SEED, F.col("in_window"), DELTA)
    shipped = timed.withColumn("shipped_qty", P.shipped_quantity(F.col("quantity"), F.col("in_window"), CAPACITY))
    return P.order_status(shipped, hi)


_LEAD = f"greatest(1, CAST(round_even(lead_time_mean_days + CASE WHEN in_window THEN {DELTA} ELSE 0 END + lead_time_std_days * {normal('lead_time', 'po_id')}, 0) AS BIGINT))"
_LATE = f"CASE WHEN {uniform('late', 'po_id')} >= on_time_probability THEN CAST(floor({uniform('delay', 'po_id')} * 3.0) + 1 AS BIGINT) ELSE 0 END"
define(
    "timed_orders",
    f"""
SELECT *, CASE WHEN shipped_qty = 0 THEN 'not_shipped' WHEN expected_arrival_date > hi THEN 'open' WHEN shipped_qty < quantity THEN 'partially_received' ELSE 'received' END AS status,
       CASE WHEN shipped_qty > 0 AND expected_arrival_date <= hi THEN expected_arrival_date END AS received_date
FROM (SELECT *, CAST(order_date + CAST(sampled_lead_time_days AS INTEGER) AS DATE) AS expected_arrival_date,
             CAST(CASE WHEN in_window THEN ceil(quantity * {CAPACITY}) ELSE quantity END AS BIGINT) AS shipped_qty
      FROM (SELECT *, CAST({_LEAD} + {_LATE} AS BIGINT) AS sampled_lead_time_days
            FROM (SELECT *, order_date - lo >= {WINDOW_START} AND order_date - lo < {WINDOW_START + WINDOW_DAYS} AS in_window FROM po JOIN lead USING (supplier_id) CROSS JOIN stock_bounds)))
""",
    "po", "lead", "stock_bounds",
)


@query("po_lead_time", with_ctes("timed_orders", "SELECT po_id, supplier_id, order_date, in_window, sampled_lead_time_days, expected_arrival_date FROM timed_orders"))
def po_lead_time(t):
    return timed_orders(t).select("po_id", "supplier_id", "order_date", "in_window", "sampled_lead_time_days", "expected_arrival_date")


@query("po_shipped_qty", with_ctes("timed_orders", "SELECT po_id, quantity, in_window, shipped_qty, quantity - shipped_qty AS shortfall FROM timed_orders"))
def po_shipped_qty(t):
    return timed_orders(t).select("po_id", "quantity", "in_window", "shipped_qty", (F.col("quantity") - F.col("shipped_qty")).alias("shortfall"))


@query(
    "po_status",
    with_ctes("timed_orders", """SELECT po_id, product_id || '.' || warehouse_id || '.d' || lpad(CAST(order_date - lo AS VARCHAR), 4, '0') AS order_text,
    quantity, shipped_qty, expected_arrival_date, received_date, status FROM timed_orders"""),
)
def po_status(t):
    lo, _ = I.stock_bounds(t)
    text = P.po_text(F.col("product_id"), F.col("warehouse_id"), day_index(F.col("order_date"), lo))
    return timed_orders(t).select("po_id", text.alias("order_text"), "quantity", "shipped_qty", "expected_arrival_date", "received_date", "status")


define(
    "po_receipts",
    "SELECT product_id, warehouse_id, expected_arrival_date AS date, CAST(sum(shipped_qty) AS BIGINT) AS arrivals FROM timed_orders WHERE received_date IS NOT NULL GROUP BY ALL",
    "timed_orders",
)


@query("receipts_by_day", with_ctes("po_receipts", "SELECT * FROM po_receipts"))
def receipts_by_day(t):
    return P.receipts_by_day(timed_orders(t), I.stock_bounds(t)[1])


def outstanding(t):
    return L.on_order(L.order_movements(timed_orders(t)))


define(
    "outstanding",
    """SELECT product_id, warehouse_id, date, CAST(sum(delta) OVER (PARTITION BY product_id, warehouse_id ORDER BY date) AS BIGINT) AS on_order FROM (
SELECT product_id, warehouse_id, date, sum(delta) AS delta FROM (
 SELECT product_id, warehouse_id, order_date AS date, shipped_qty AS delta FROM timed_orders
 UNION ALL SELECT product_id, warehouse_id, received_date, -shipped_qty FROM timed_orders WHERE received_date IS NOT NULL) GROUP BY ALL)""",
    "timed_orders",
)
define(
    "positions",
    """SELECT l.*, CAST(coalesce(last_value(on_order IGNORE NULLS) OVER (PARTITION BY l.product_id, l.warehouse_id ORDER BY l.date), 0) AS BIGINT) AS on_order
FROM ledger l LEFT JOIN outstanding o ON o.product_id = l.product_id AND o.warehouse_id = l.warehouse_id AND o.date = l.date""",
    "ledger", "outstanding",
)


def positions(t):
    return L.with_position(I.single_ledger(t), outstanding(t))


@query("on_order_rollforward", with_ctes("positions", "SELECT date, product_id, warehouse_id, closing_on_hand, on_order, closing_on_hand + on_order AS inventory_position FROM positions"))
def on_order_rollforward(t):
    return positions(t).select("date", *ITEM, "closing_on_hand", "on_order", "inventory_position")


@query(
    "accounting_identity_check",
    with_ctes("positions", """, rows AS (SELECT *, closing_on_hand + on_order AS inventory_position, lag(closing_on_hand) OVER (PARTITION BY product_id, warehouse_id ORDER BY date) AS previous FROM positions)
SELECT rule, CAST(violations AS BIGINT) AS violations FROM (
 SELECT 'opening' AS rule, count(*) FILTER (previous IS NOT NULL AND opening_on_hand <> previous + arrivals) AS violations FROM rows
 UNION ALL SELECT 'demand_split', count(*) FILTER (fulfilled + lost_sales <> demand) FROM rows
 UNION ALL SELECT 'closing', count(*) FILTER (closing_on_hand <> opening_on_hand - fulfilled) FROM rows
 UNION ALL SELECT 'position', count(*) FILTER (inventory_position <> closing_on_hand + on_order) FROM rows
 UNION ALL SELECT 'non_negative', count(*) FILTER (closing_on_hand < 0) FROM rows)"""),
)
def accounting_identity_check(t):
    return L.identity_violations(positions(t))


RATE = 0.25
define("unit_costs", f"SELECT product_id, {even('avg(unit_price)', 4)} AS unit_price, {even(even('avg(unit_price)', 4) + ' * 0.7', 2)} AS unit_cost FROM price GROUP BY ALL", "price")
define("order_costs", f"SELECT s_suppkey AS supplier_id, {even('20.0 + ' + uniform('order_cost', 's_suppkey') + ' * 40.0', 2)} AS order_cost FROM supplier")


def order_costs(t):
    key = F.col("s_suppkey")
    return t.raw("supplier").select(key.alias("supplier_id"), uniform_between(seeded_uniform(SEED, "order_cost", key), 20.0, 60.0, 2).alias("order_cost"))


def costs(t):
    """Unit cost, mean price and holding rate per item, from one pass over the lines."""
    from stockweave.functions.numeric import round_half_even

    return A.priced_items(t.price).select(
        "product_id", F.col("store_id").alias("warehouse_id"), round_half_even(F.col("avg_unit_price") * 0.7, 2).alias("unit_cost"),
        F.col("avg_unit_price").alias("unit_price"), F.lit(RATE).alias("holding_cost_rate_annual"),
    )


@query(
    "item_costs",
    with_ctes("unit_costs entities", f"SELECT product_id, store_id AS warehouse_id, unit_cost, unit_price, CAST({RATE} AS DOUBLE) AS holding_cost_rate_annual FROM entities JOIN unit_costs USING (product_id)"),
)
def item_costs(t):
    """Costs joined table by table, as a caller with separate price, supplier and warehouse tables has them."""
    from stockweave.functions.numeric import round_half_even

    price = A.mean_price(t.price)
    supplied = price.select("product_id", round_half_even(F.col("avg_unit_price") * 0.7, 2).alias("unit_cost"))
    houses = t.raw("region").select(F.col("r_name").alias("warehouse_id"), F.lit(RATE).alias("holding_cost_rate_annual"))
    items = t.price.select("product_id", F.col("store_id").alias("warehouse_id")).distinct()
    return K.item_costs(items, supplied, price, houses)


def cents(expression: str) -> str:
    return f"floor(({expression}) * 100 + 0.5) / 100"


def stable2(column):
    return F.floor(column * F.lit(100) + F.lit(0.5)).cast("double") / F.lit(100)


# KPI inputs summed per ledger group; one group, or one per (run, variant).
def _kpi_sql(group: str, source: str) -> str:
    g = f"{group}, " if group else ""
    return f"""
SELECT {g}count(*) AS items, sum(d) AS demand, sum(f) AS fulfilled, sum(l) AS lost, sum(so) AS stockouts, sum(c) AS stock, sum(c * unit_cost) AS value,
       sum(c * unit_cost * {RATE} / 365.0) AS holding, sum(l * unit_price) AS lost_cost, sum(f * unit_cost) AS cogs
FROM (SELECT {g}product_id, warehouse_id, sum(demand) AS d, sum(fulfilled) AS f, sum(lost_sales) AS l, sum(closing_on_hand) AS c, count(*) FILTER (lost_sales > 0) AS so
      FROM {source} GROUP BY ALL) JOIN unit_costs USING (product_id) {f'GROUP BY {group}' if group else ''}"""


define("kpi_base", _kpi_sql("", "ledger"), "ledger", "unit_costs")
define("kpi_groups", _kpi_sql("run_id, variant", "ledgers"), "ledgers", "unit_costs")
define("kpi_orders", "SELECT count(*) AS orders, sum(quantity) AS units, sum(order_cost) AS ordering FROM po JOIN order_costs USING (supplier_id)", "po", "order_costs")
define("horizon_days", "SELECT CAST(hi - lo + 1 AS DOUBLE) AS days FROM stock_bounds", "stock_bounds")
_KPI_VALUES = {
    "demand_total": "demand", "fulfilled_units": "fulfilled", "lost_sales_units": "lost",
    "fill_rate": "CASE WHEN demand > 0 THEN fulfilled / CAST(demand AS DOUBLE) END", "stockout_days": "stockouts",
    "stockout_day_rate": "stockouts / (items * days)", "avg_on_hand_units": "stock / days", "avg_on_hand_value": "value / days",
    "inventory_turnover": "cogs / (value / days) * 365.0 / days", "purchase_orders": "orders", "units_ordered": "units",
    "order_frequency": "orders / (items * days / 7.0)", "ordering_cost": "ordering", "holding_cost": "holding", "inventory_cost": "ordering + holding",
    "lost_sales_cost": "lost_cost", "total_cost": "ordering + holding + lost_cost",
}
# Money is compared to the cent; ratios to six places.
_FINE = {"fill_rate", "stockout_day_rate", "inventory_turnover", "order_frequency"}
KPI_COLUMNS_SQL = ", ".join(f"CAST({r6(v) if m in _FINE else cents(v)} AS DOUBLE) AS {m}" for m, v in _KPI_VALUES.items())


def stable_kpis(df):
    return df.withColumns({m: (stable6 if m in _FINE else stable2)(F.col(m)) for m in K.KPI_UNITS})


def horizon_days(t):
    lo, hi = I.stock_bounds(t)
    return F.datediff(hi, lo) + 1


define("kpi_single", f"SELECT {KPI_COLUMNS_SQL} FROM kpi_base CROSS JOIN kpi_orders CROSS JOIN horizon_days", "kpi_base", "kpi_orders", "horizon_days")
define("kpi_runs", f"SELECT run_id, variant, {KPI_COLUMNS_SQL} FROM kpi_groups CROSS JOIN kpi_orders CROSS JOIN horizon_days", "kpi_groups", "kpi_orders", "horizon_days")
_UNIT_ROWS = " UNION ALL ".join(f"SELECT '{m}' AS metric_id, {m} AS value, '{u}' AS unit, 'total' AS scope FROM kpi_single" for m, u in K.KPI_UNITS.items())


@query("inventory_kpis", with_ctes("kpi_single", _UNIT_ROWS))
def inventory_kpis(t):
    kpis = K.inventory_kpis(I.single_ledger(t), t.supplier_orders, costs(t), order_costs(t), horizon_days(t))
    return K.metric_rows(stable_kpis(kpis))


def tagged_orders(t, runs):
    """Order totals per supplier, charged to every (run, variant): summed first, then repeated."""
    tags = F.array(*[F.struct(F.lit(r).alias("run_id"), F.lit(v).alias("variant")) for r in runs for v in ("cover_07", "cover_14", "cover_28")])
    return t.supplier_orders.select("*", F.inline(tags))


def kpis_by_run(t, runs=("baseline", "stress")):
    kpis = K.inventory_kpis(I.variant_ledgers(t, runs), tagged_orders(t, runs), costs(t), order_costs(t), horizon_days(t), ("run_id", "variant"))
    return stable_kpis(kpis)


def metric_rows_by_run(t):
    return K.metric_rows(kpis_by_run(t), ("run_id", "variant"))


@query("fill_rate_by_scope", with_ctes("ledger", f"SELECT CASE WHEN grouping(product_id) = 1 THEN 'total' ELSE 'product:' || product_id END AS scope, {r6('CASE WHEN sum(demand) > 0 THEN sum(fulfilled) / CAST(sum(demand) AS DOUBLE) END')} AS fill_rate FROM ledger GROUP BY ROLLUP (product_id)"))
def fill_rate_by_scope(t):
    return K.fill_rate_by_scope(I.single_ledger(t)).withColumn("fill_rate", stable6(F.col("fill_rate")))


define("capacity", f"SELECT warehouse_id, CAST({even('20.0 * sum(demand) / (SELECT days FROM horizon_days)')} AS BIGINT) AS capacity_units FROM order_demand GROUP BY ALL", "order_demand", "horizon_days")


@query("capacity_breaches", with_ctes("ledger capacity", "SELECT warehouse_id, date, CAST(sum(closing_on_hand) AS BIGINT) AS closing_on_hand, capacity_units FROM ledger JOIN capacity USING (warehouse_id) GROUP BY ALL HAVING sum(closing_on_hand) > capacity_units"))
def capacity_breaches(t):
    total = t.order_demand.groupBy("warehouse_id").agg(F.sum("demand").alias("d"))
    capacity = total.select("warehouse_id", round_half_even_int(F.lit(20.0) * F.col("d") / horizon_days(t)).alias("capacity_units"))
    return L.capacity_breaches(I.single_ledger(t), capacity)


@query("policy_scorecard", with_ctes("kpi_runs", "SELECT * EXCLUDE (run_id), row_number() OVER (ORDER BY total_cost, variant) AS cost_rank FROM kpi_runs WHERE run_id = 'baseline'"))
def policy_scorecard(t):
    return R.policy_scorecard(kpis_by_run(t, ("baseline",)).drop("run_id"))


@query("metrics_pivot", with_ctes("kpi_runs", "SELECT run_id || '/' || variant AS variant, * EXCLUDE (run_id, variant) FROM kpi_runs"))
def metrics_pivot(t):
    rows = metric_rows_by_run(t).withColumn("variant", F.concat_ws("/", "run_id", "variant")).drop("run_id")
    return R.metrics_pivot(rows)


_COMPARED = ("fill_rate", "lost_sales_units", "avg_on_hand_units", "total_cost")


@query("run_comparison", with_ctes("kpi_runs", f"SELECT run_id, variant, {', '.join(_COMPARED)} FROM kpi_runs"))
def run_comparison(t):
    return R.run_comparison(metric_rows_by_run(t), ["baseline", "stress"], _COMPARED)


_DELTAS = " UNION ALL ".join(
    f"SELECT s.run_id, s.variant, '{m}' AS metric_id, s.{m} AS value, b.{m} AS base_value, {cents(f's.{m} - b.{m}')} AS delta, {r6(f'CASE WHEN b.{m} > 0 THEN s.{m} / b.{m} END')} AS ratio "
    "FROM kpi_runs s JOIN kpi_runs b ON s.variant = b.variant AND b.run_id = 'baseline' AND s.run_id = 'stress'"
    for m in K.KPI_UNITS
)


@query("metric_delta_vs_base", with_ctes("kpi_runs", _DELTAS))
def metric_delta_vs_base(t):
    delta = R.metric_delta(metric_rows_by_run(t), "baseline")
    return delta.select("run_id", "variant", "metric_id", "value", "base_value", stable2(F.col("delta")).alias("delta"), stable6(F.col("ratio")).alias("ratio"))


@query(
    "disruption_effect",
    with_ctes("timed_orders", f"""SELECT in_window, CAST(count(*) AS BIGINT) AS orders, {r6('sum(sampled_lead_time_days) / CAST(count(*) AS DOUBLE)')} AS mean_lead_time,
    {r6('sum(shipped_qty) / CAST(sum(quantity) AS DOUBLE)')} AS shipped_share FROM timed_orders GROUP BY ALL"""),
)
def disruption_effect(t):
    effect = P.disruption_effect(timed_orders(t))
    return effect.withColumns({c: stable6(F.col(c)) for c in ("mean_lead_time", "shipped_share")})


@query(
    "horizon_coverage",
    with_ctes("order_demand stock_bounds", """SELECT product_id, warehouse_id, CAST((SELECT hi - lo + 1 FROM stock_bounds) - count(DISTINCT date) AS BIGINT) AS missing_days FROM order_demand GROUP BY ALL"""),
)
def horizon_coverage(t):
    lo, hi = I.stock_bounds(t)
    return L.horizon_coverage(t.order_demand, t.order_demand, lo, hi)
