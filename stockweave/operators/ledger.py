"""Stock ledgers from recorded receipts and demand.

The balance ``I_t = max(I_{t-1} + a_t - d_t, 0)`` has a closed form in two running aggregates, so the
ledger is one window pass per item (one row per day) and never a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockweave.functions.numeric import as_column
from stockweave.operators.spine import date_sequence, keyed_rows

ITEM = ("product_id", "warehouse_id")


def daily_movements(demand: DataFrame, receipts: DataFrame, lo: object, hi: object, item: Sequence[str] = ITEM) -> DataFrame:
    """Arrivals and demand for every item and day between two dates, 0 where nothing moved."""
    zero = F.lit(0).cast("bigint")
    moves = demand.select("date", *item, zero.alias("arrivals"), "demand").unionByName(
        receipts.select("date", *item, "arrivals", zero.alias("demand"))
    )
    return fill_movements(moves.groupBy("date", *item).agg(F.sum("arrivals").alias("arrivals"), F.sum("demand").alias("demand")), lo, hi, item)


def fill_movements(daily: DataFrame, lo: object, hi: object, item: Sequence[str] = ITEM) -> DataFrame:
    """Daily arrivals and demand on the full spine of every item."""
    zero = F.lit(0).cast("bigint")
    # As in the demand grid: both branches get the same plan below the sums and share one shuffle.
    daily = keyed_rows(daily, ["date", *item])
    known = daily.groupBy(*item).agg(F.count("arrivals").alias("_a"), F.count("demand").alias("_d")).where("_a >= 0 AND _d >= 0")
    spine = known.select(F.explode(date_sequence(lo, hi)).alias("date"), *item)
    joined = spine.join(daily, ["date", *item], "left")
    return joined.select("date", *item, F.coalesce("arrivals", zero).alias("arrivals"), F.coalesce("demand", zero).alias("demand"))


def stock_ledger(movements: DataFrame, opening: str = "opening_units", item: Sequence[str] = ITEM) -> DataFrame:
    """Opening, arrivals, demand, fulfilled, lost and closing units per item and day.

    ``opening`` names the column with the item's stock before the first day. Unmet demand is lost.
    """
    order = W.partitionBy(*item).orderBy("date")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    free = F.col(opening) + F.sum(F.col("arrivals") - F.col("demand")).over(upto)
    balance = movements.withColumn("_free", free).withColumn("_low", F.min("_free").over(upto))
    closing = balance.withColumn("closing_on_hand", F.col("_free") - F.least(F.lit(0), F.col("_low")))
    previous = F.coalesce(F.lag("closing_on_hand").over(order), F.col(opening))
    opened = closing.withColumn("opening_on_hand", previous + F.col("arrivals"))
    fulfilled = F.col("opening_on_hand") - F.col("closing_on_hand")
    return opened.select(
        "date", *item, "opening_on_hand", "arrivals", "demand",
        fulfilled.alias("fulfilled"), (F.col("demand") - fulfilled).alias("lost_sales"), "closing_on_hand",
    )


def order_movements(orders: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """Signed on-order changes of purchase orders: shipped units in, received units out.

    Both movements of an order come from one pass over the order.
    """
    moves = F.array(
        F.struct(F.col("order_date").alias("date"), F.col("shipped_qty").alias("units")),
        F.struct(F.col("received_date").alias("date"), (-F.col("shipped_qty")).alias("units")),
    )
    return orders.select(*item, F.inline(moves)).where(F.col("date").isNotNull())


def on_order(moves: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """Outstanding units per item and movement day: the running sum of signed movements."""
    daily = moves.groupBy(*item, "date").agg(F.sum("units").alias("_delta"))
    upto = W.partitionBy(*item).orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.select(*item, "date", F.sum("_delta").over(upto).alias("on_order"))


def with_position(ledger: DataFrame, outstanding: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """Ledger days with the last known on-order units and the inventory position."""
    order = W.partitionBy(*item).orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = ledger.join(outstanding, [*item, "date"], "left")
    carried = F.coalesce(F.last("on_order", ignorenulls=True).over(order), F.lit(0))
    placed = joined.withColumn("on_order", carried)
    return placed.withColumn("inventory_position", F.col("closing_on_hand") + F.col("on_order"))


def identity_violations(ledger: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """Ledger rows that break an accounting rule, counted per rule."""
    previous = F.lag("closing_on_hand").over(W.partitionBy(*item).orderBy("date"))
    rows = ledger.withColumn("_previous", previous)
    rules = {
        "opening": F.col("_previous").isNotNull() & (F.col("opening_on_hand") != F.col("_previous") + F.col("arrivals")),
        "demand_split": F.col("fulfilled") + F.col("lost_sales") != F.col("demand"),
        "closing": F.col("closing_on_hand") != F.col("opening_on_hand") - F.col("fulfilled"),
        "position": F.col("inventory_position") != F.col("closing_on_hand") + F.col("on_order"),
        "non_negative": F.col("closing_on_hand") < 0,
    }
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def capacity_breaches(ledger: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Warehouse-days whose closing stock exceeds the capacity (reported, not enforced)."""
    stock = ledger.groupBy("warehouse_id", "date").agg(F.sum("closing_on_hand").alias("closing_on_hand"))
    return stock.join(warehouses.select("warehouse_id", "capacity_units"), "warehouse_id").where("closing_on_hand > capacity_units")


def horizon_coverage(demand: DataFrame, items: DataFrame, lo: object, hi: object, item: Sequence[str] = ITEM, time: str = "date") -> DataFrame:
    """Days of the horizon without a demand row, per item (0 when covered)."""
    first, last = as_column(lo).cast("date"), as_column(hi).cast("date")
    inside = demand.where((F.col(time) >= first) & (F.col(time) <= last))
    covered = inside.groupBy(*item).agg(F.countDistinct(time).alias("_covered"))
    length = F.datediff(last, first) + 1
    joined = items.select(*item).distinct().join(covered, list(item), "left")
    return joined.select(*item, (length - F.coalesce("_covered", F.lit(0))).cast("bigint").alias("missing_days"))
