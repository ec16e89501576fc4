"""Canonical views over the supplied star-schema tables.

``sales`` and the other views are built lazily. At large scale the lineitem joins shuffle on the order,
part and supplier keys and hash the other table (``DriverTables.held``): lines pass through a task and are
not sorted in it, and Spark splits skewed keys. Sums are combined before the last shuffle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.functions import calendar as C
from stockweave.functions.numeric import round_half_even, round_half_even_int
from stockweave.functions.random import seeded_uniform, uniform_between
from stockweave.operators.spine import date_spine

SEED = 20260927
ORDER_ROWS = 250_000  # lines of one task that holds whole orders
BROADCAST_ROWS = 500_000  # rows of a table that every executor may hold

# Columns of the supplied tables; a declared schema saves a footer-reading job per table.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


class DriverTables:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path
        self._raw: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}.parquet")
        return self._raw[name]

    def rows(self, name: str) -> int:
        """How many rows a table has, from the file footers."""
        if name not in self._rows:
            self._rows[name] = self.raw(name).count()
        return self._rows[name]

    def held(self, name: str, side: DataFrame) -> DataFrame:
        """Columns of the table ``name`` as the side of a join that tasks hold while the lines pass.

        A short table goes whole to every executor, a long one in shares to the tasks. A sort-merge join holds the lines
        instead: as many as there are for each shuffle partition, whose number need not grow with them.
        """
        return F.broadcast(side) if self.rows(name) <= BROADCAST_ROWS else side.hint("shuffle_hash")

    @cached_property
    def ship_bounds(self) -> DataFrame:
        """First and last sales day: a one-column scan (every line has a part and a supplier)."""
        dates = self.raw("lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
        return dates.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))

    def with_store(self, rows: DataFrame, supplier_key: str) -> DataFrame:
        """Attach ``store_id`` (the supplier's region).

        Joined table by table: each side is a file of known size; the size of a joined side would only be
        a guess. Nations and regions are short lists at any number of lines and are always broadcast: dealt by their keys, all
        rows would meet in one task per nation, and then in one per region.
        """
        supplier = self.held("supplier", self.raw("supplier").select("s_suppkey", "s_nationkey"))
        nation = self.raw("nation").select("n_nationkey", "n_regionkey")
        region = self.raw("region").select("r_regionkey", F.col("r_name").alias("store_id"))
        return (
            rows.join(supplier, F.col(supplier_key) == F.col("s_suppkey"))
            .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
            .drop("s_suppkey", "s_nationkey", "n_nationkey", "n_regionkey", "r_regionkey")
        )

    def _items(self, lines: DataFrame) -> DataFrame:
        """Attach the product and the store of a line."""
        part = self.held("part", self.raw("part").select("p_partkey", F.col("p_type").alias("product_id")))
        return self.with_store(lines.join(part, F.col("l_partkey") == F.col("p_partkey")), "l_suppkey")

    @cached_property
    def lines(self) -> DataFrame:
        """One row per order line: ship date, product, store, units and cents."""
        lines = self.raw("lineitem").select(
            F.col("l_shipdate").cast("date").alias("date"),
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            F.col("l_quantity").cast("bigint").alias("quantity"),
            round_half_even_int(F.col("l_extendedprice") * 100).alias("cents"),
        )
        return self._items(lines)

    @cached_property
    def sales(self) -> DataFrame:
        return self.lines.groupBy("date", "product_id", "store_id").agg(F.sum("quantity").alias("quantity"))

    @cached_property
    def price(self) -> DataFrame:
        """Mean unit price in whole cents per week, product and store."""
        weekly = self.lines.groupBy(
            C.iso_week_id(F.col("date")).alias("week_id"), "product_id", "store_id"
        ).agg(F.sum("cents").alias("cents"), F.sum("quantity").alias("units"))
        return weekly.select(
            "week_id", "product_id", "store_id", round_half_even(F.col("cents") / F.col("units") / 100, 2).alias("unit_price")
        )

    @cached_property
    def day_totals(self) -> DataFrame:
        """Units and cents per ship day, product and store: what sales and prices are both derived from.

        The filters keep both sums in every use, so that branches of one query share the shuffle.
        """
        sums = [F.sum("quantity").alias("quantity"), F.sum("cents").alias("cents")]
        return self.lines.groupBy("date", "product_id", "store_id").agg(*sums).where("quantity IS NOT NULL AND cents IS NOT NULL")

    @cached_property
    def day_price(self) -> DataFrame:
        """As ``price``, from ``day_totals``."""
        weekly = self.day_totals.groupBy(C.iso_week_id(F.col("date")).alias("week_id"), "product_id", "store_id").agg(F.sum("cents").alias("cents"), F.sum("quantity").alias("units"))
        return weekly.select("week_id", "product_id", "store_id", round_half_even(F.col("cents") / F.col("units") / 100, 2).alias("unit_price"))

    @cached_property
    def supplier_orders(self) -> DataFrame:
        """Orders and units per supplier, straight from the lines: their keys refer to existing orders and parts."""
        lines = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("quantity"))
        placed = lines.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.sum("quantity").alias("quantity"))
        return placed.groupBy(F.col("l_suppkey").alias("supplier_id")).agg(F.count(F.lit(1)).alias("orders"), F.sum("quantity").alias("units"))

    @cached_property
    def calendar(self) -> DataFrame:
        spine = date_spine(self.ship_bounds, F.col("lo"), F.col("hi"))
        date = F.col("date")
        return spine.select(
            "date",
            C.iso_week_id(date).alias("week_id"),
            C.iso_weekday(date).alias("weekday"),
            F.month("date").cast("bigint").alias("month"),
            F.year("date").cast("bigint").alias("year"),
        )

    @cached_property
    def lead_times(self) -> DataFrame:
        """Lead time figures per supplier, drawn from keyed uniforms."""
        key = F.col("s_suppkey")

        def draw(column: str, low: float, high: float, decimals: int):
            return uniform_between(seeded_uniform(SEED, column, key), low, high, decimals)

        return self.raw("supplier").select(
            key.alias("supplier_id"),
            draw("lead_time_mean_days", 4.0, 10.0, 2).alias("lead_time_mean_days"),
            draw("lead_time_std_days", 0.5, 2.0, 2).alias("lead_time_std_days"),
            draw("on_time_probability", 0.85, 0.99, 3).alias("on_time_probability"),
        )

    @cached_property
    def order_tasks(self) -> int:
        """How many tasks share the orders: by the lines' number, read from the file footers; one per core at least."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.rows("lineitem") // ORDER_ROWS))

    def _ordered(self, lines: DataFrame, day: str, grouped: bool = False) -> DataFrame:
        """Attach the order's day; ``grouped``: with all lines of an order in one task.

        Lines are dealt by order key in tasks of ``ORDER_ROWS``: left to Spark, partitions are merged to one per core or
        64 MB of shuffle. Where the orders go whole to every executor, only grouping needs that.
        """
        orders = self.raw("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias(day))
        if grouped or self.rows("orders") > BROADCAST_ROWS:
            lines = lines.repartition(self.order_tasks, "l_orderkey")
        return lines.join(self.held("orders", orders), F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def purchase_orders(self) -> DataFrame:
        """One order per (order, line number, part, supplier) with summed units.

        Nearly every line is a group of its own, so both hash tables of a task hold all its lines. The number of tasks
        grows with the lines.
        """
        lines = self.raw("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("quantity")
        )
        # Joined by the order key first: the grouping contains it, so it needs no second exchange.
        dated = self._ordered(lines, "order_date", grouped=True).groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "order_date").agg(F.sum("quantity").alias("quantity"))
        return self._items(dated).select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("po_id"),
            "product_id",
            F.col("store_id").alias("warehouse_id"),
            F.col("l_suppkey").alias("supplier_id"),
            "order_date",
            "quantity",
        )

    @cached_property
    def stock_moves(self) -> DataFrame:
        """Arrivals by ship day and demand by order day per item, from one pass over the lines."""
        lines = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("ship_day"), F.col("l_quantity").cast("bigint").alias("quantity")
        )
        items = self._items(self._ordered(lines, "order_day"))
        zero = F.lit(0).cast("bigint")
        moves = F.array(
            F.struct(F.col("ship_day").alias("date"), F.col("quantity").alias("arrivals"), zero.alias("demand")),
            F.struct(F.col("order_day").alias("date"), zero.alias("arrivals"), F.col("quantity").alias("demand")),
        )
        rows = items.select("product_id", F.col("store_id").alias("warehouse_id"), F.inline(moves))
        return rows.groupBy("date", "product_id", "warehouse_id").agg(F.sum("arrivals").alias("arrivals"), F.sum("demand").alias("demand"))

    @cached_property
    def receipts(self) -> DataFrame:
        """Units by ship day: the recorded arrivals of the stock ledger."""
        return self.sales.select("date", "product_id", F.col("store_id").alias("warehouse_id"), F.col("quantity").alias("arrivals"))

    @cached_property
    def order_demand(self) -> DataFrame:
        """Units by order day: the demand of the stock ledger."""
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("quantity"))
        items = self._items(self._ordered(lines, "date"))
        return items.groupBy("date", "product_id", F.col("store_id").alias("warehouse_id")).agg(F.sum("quantity").alias("demand"))
