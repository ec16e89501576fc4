"""Service, stock and cost KPIs of stock ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.numeric import as_column, ratio_or_null
from stockweave.operators.joins import many_to_one, require_values
from stockweave.operators.ledger import ITEM

# KPI names and units, in report order.
KPI_UNITS = {
    "demand_total": "units",
    "fulfilled_units": "units",
    "lost_sales_units": "units",
    "fill_rate": "ratio",
    "stockout_days": "item-days",
    "stockout_day_rate": "ratio",
    "avg_on_hand_units": "units",
    "avg_on_hand_value": "USD",
    "inventory_turnover": "turns per year",
    "purchase_orders": "orders",
    "units_ordered": "units",
    "order_frequency": "orders per item per week",
    "ordering_cost": "USD",
    "holding_cost": "USD",
    "inventory_cost": "USD",
    "lost_sales_cost": "USD",
    "total_cost": "USD",
}
COST_COLUMNS = ("unit_cost", "unit_price", "holding_cost_rate_annual")


def item_costs(items: DataFrame, product_supplier: DataFrame, product_price: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Unit cost, mean price and holding rate of every item."""
    return (
        items.select(*ITEM)
        .join(product_supplier.select("product_id", "unit_cost"), "product_id")
        .join(product_price.select("product_id", F.col("avg_unit_price").alias("unit_price")), "product_id")
        .join(warehouses.select("warehouse_id", "holding_cost_rate_annual"), "warehouse_id")
        .select(*ITEM, *COST_COLUMNS)
    )


def item_totals(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ledger units per item: whole-number sums, combined before the shuffle."""
    sums = [F.sum(c).alias(c) for c in ("demand", "fulfilled", "lost_sales", "closing_on_hand")]
    return ledger.groupBy(*by, *ITEM).agg(*sums, F.count_if(F.col("lost_sales") > 0).alias("stockout_days"))


def order_totals(purchase_orders: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Orders and units per supplier."""
    return purchase_orders.groupBy(*by, "supplier_id").agg(F.count(F.lit(1)).alias("orders"), F.sum("quantity").alias("units"))


def inventory_kpis(
    ledger: DataFrame, supplier_orders: DataFrame, costs: DataFrame, order_costs: DataFrame, horizon_days: object, by: Sequence[str] = ()
) -> DataFrame:
    """The 17 KPIs as columns, overall or per ``by`` group (for example a policy variant).

    ``supplier_orders``: see ``order_totals``; ``order_costs``: (supplier_id, order_cost). Undefined ratios are null. Costs meet the ledger
    after it is summed per item, so the join sees one row per item.
    """
    days = as_column(horizon_days).cast("double")
    totals = require_values(many_to_one(item_totals(ledger, by), costs, ITEM, "left", hot_left=False), COST_COLUMNS, "cost data missing")
    stock_value = F.col("closing_on_hand") * F.col("unit_cost")
    stock = totals.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_items"),
        F.sum("demand").cast("double").alias("demand_total"),
        F.sum("fulfilled").cast("double").alias("fulfilled_units"),
        F.sum("lost_sales").cast("double").alias("lost_sales_units"),
        F.sum("stockout_days").cast("double").alias("stockout_days"),
        F.sum("closing_on_hand").cast("double").alias("_stock"),
        F.sum(stock_value).alias("_value"),
        F.sum(stock_value * F.col("holding_cost_rate_annual") / F.lit(365.0)).alias("holding_cost"),
        F.sum(F.col("lost_sales") * F.col("unit_price")).alias("lost_sales_cost"),
        F.sum(F.col("fulfilled") * F.col("unit_cost")).alias("_cogs"),
    )
    priced = many_to_one(supplier_orders, order_costs.select("supplier_id", "order_cost"), ["supplier_id"], "left", hot_left=False)
    orders = require_values(priced, ["order_cost"], "order cost missing").groupBy(*by).agg(
        F.sum("orders").alias("_orders"), F.sum("units").alias("_units"), F.sum(F.col("orders") * F.col("order_cost")).alias("_ordering")
    )
    if by:
        joined = stock.join(orders, list(by), "left")
    else:
        only = orders.select(F.struct("_orders", "_units", "_ordering").alias("o")).scalar()  # one row
        joined = stock.withColumn("_o", only).select("*", "_o.*").drop("_o")
    zero = F.lit(0.0)
    item_days = F.col("_items") * days
    values: dict[str, Column] = {
        "fill_rate": ratio_or_null(F.col("fulfilled_units"), F.col("demand_total")),
        "stockout_day_rate": ratio_or_null(F.col("stockout_days"), item_days),
        "avg_on_hand_units": F.col("_stock") / days,
        "avg_on_hand_value": F.col("_value") / days,
        "inventory_turnover": ratio_or_null(F.col("_cogs"), F.col("_value") / days) * F.lit(365.0) / days,
        "purchase_orders": F.coalesce(F.col("_orders").cast("double"), zero),
        "units_ordered": F.coalesce(F.col("_units").cast("double"), zero),
        "order_frequency": ratio_or_null(F.coalesce(F.col("_orders"), F.lit(0)), item_days / F.lit(7.0)),
        "ordering_cost": F.coalesce(F.col("_ordering"), zero),
        "inventory_cost": F.coalesce(F.col("_ordering"), zero) + F.col("holding_cost"),
        "total_cost": F.coalesce(F.col("_ordering"), zero) + F.col("holding_cost") + F.col("lost_sales_cost"),
    }
    return joined.withColumns(values).select(*by, *KPI_UNITS)


def metric_rows(kpis: DataFrame, by: Sequence[str] = (), units: dict[str, str] | None = None, scope: str = "total") -> DataFrame:
    """KPI columns as (metric_id, value, unit, scope) rows."""
    units = units or KPI_UNITS
    cells = [F.struct(F.lit(m).alias("metric_id"), F.col(m).cast("double").alias("value"), F.lit(u).alias("unit")) for m, u in units.items()]
    return kpis.select(*by, F.inline(F.array(*cells))).withColumn("scope", F.lit(scope))


def fill_rate_by_scope(ledger: DataFrame) -> DataFrame:
    """Fill rate overall and per product, from one pass with grouping sets."""
    product = F.when(F.grouping("product_id") == 1, F.lit("total")).otherwise(F.concat(F.lit("product:"), F.col("product_id")))
    return (
        ledger.rollup("product_id")
        .agg(F.sum("fulfilled").alias("fulfilled"), F.sum("demand").alias("demand"), product.alias("scope"))
        .select("scope", ratio_or_null(F.col("fulfilled"), F.col("demand")).alias("fill_rate"))
    )
