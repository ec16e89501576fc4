"""Inputs that several query modules share, each derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.functions.random import hash48
from stockweave.operators import spine
from stockweave.operators.fingerprint import content_fingerprint
from stockweave.queries.sqlparts import define, hash48 as sql_hash48
from stockweave.sources import retail
from stockweave.sources.drivertables import DriverTables

ENTITIES = ("product_id", "store_id")
ITEM = ("product_id", "warehouse_id")


def scalar(df: DataFrame, column: str):
    return df.select(column).scalar()


def sales_grid(t: DriverTables, sales: DataFrame | None = None) -> DataFrame:
    return spine.observed_grid(t.sales if sales is None else sales, "date", ENTITIES, "quantity", t.ship_bounds)


def series_ids(t: DriverTables) -> DataFrame:
    """Id columns of the wide source layout, one row per order line."""
    part = t.held("part", t.raw("part").select("p_partkey", "p_brand", "p_type"))
    lines = t.raw("lineitem").select("l_partkey", "l_suppkey")
    joined = t.with_store(lines.join(part, F.col("l_partkey") == F.col("p_partkey")), "l_suppkey")
    return joined.select(
        F.concat_ws("_", "p_type", "p_brand").alias("item_id"),
        F.col("p_type").alias("dept_id"),
        F.substring("p_type", 1, 1).alias("cat_id"),
        "store_id",
        F.substring("store_id", 1, 2).alias("state_id"),
    )


define(
    "ids",
    """
SELECT p_type || '_' || p_brand AS item_id, p_type AS dept_id, substr(p_type, 1, 1) AS cat_id, store_id,
       substr(store_id, 1, 2) AS state_id
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN stores ON l_suppkey = s_suppkey
""",
    "stores",
)


#: The region codes of the wide layout: the first two letters of every region.
SNAP_REGIONS = ("AF", "AM", "AS", "EU", "MI")


def calendar_source(t: DriverTables) -> DataFrame:
    """A calendar file as the wide layout has it: labels, Saturday-first weekdays, events, flags."""
    days = t.calendar
    first = t.ship_bounds.select("lo").scalar()
    events = retail.event_calendar(days)
    named = days.join(events, "date", "left")
    day = F.dayofmonth("date")
    second = (F.month("date") == 5) & (day == 1) & (F.col("year") % 3 == 0)
    return named.select(
        "date",
        F.col("week_id").alias("wm_yr_wk"),
        ((F.col("weekday") + 1) % 7 + 1).alias("wday"),
        "month",
        "year",
        F.concat(F.lit("d_"), (F.datediff("date", first) + 1).cast("string")).alias("d"),
        F.col("event_name").alias("event_name_1"),
        F.col("event_type").alias("event_type_1"),
        F.when(second, F.lit("SpringMarket")).alias("event_name_2"),
        F.when(second, F.lit("Cultural")).alias("event_type_2"),
        (day % 3 == 0).cast("int").alias("snap_AF"),
        ((day > 10) & (day <= 20)).cast("int").alias("snap_AM"),
        (F.month("date") % 2 == day % 2).cast("int").alias("snap_AS"),
        (F.weekday("date") >= 5).cast("int").alias("snap_EU"),
        (day <= F.month("date")).cast("int").alias("snap_MI"),
    )


define(
    "calendar_source",
    """
SELECT date, week_id AS wm_yr_wk, (weekday + 1) % 7 + 1 AS wday, month, year,
       'd_' || CAST(date - lo + 1 AS VARCHAR) AS d,
       CASE strftime(date, '%m-%d') WHEN '01-20' THEN 'WinterSale' WHEN '05-01' THEN 'LabourDay'
            WHEN '06-15' THEN 'CityRun' WHEN '08-15' THEN 'HarvestFeast' WHEN '10-03' THEN 'UnityDay' END AS event_name_1,
       CASE strftime(date, '%m-%d') WHEN '01-20' THEN 'Cultural' WHEN '05-01' THEN 'National'
            WHEN '06-15' THEN 'Sporting' WHEN '08-15' THEN 'Religious' WHEN '10-03' THEN 'National' END AS event_type_1,
       CASE WHEN strftime(date, '%m-%d') = '05-01' AND year % 3 = 0 THEN 'SpringMarket' END AS event_name_2,
       CASE WHEN strftime(date, '%m-%d') = '05-01' AND year % 3 = 0 THEN 'Cultural' END AS event_type_2,
       CAST(day(date) % 3 = 0 AS INTEGER) AS snap_AF,
       CAST(day(date) > 10 AND day(date) <= 20 AS INTEGER) AS snap_AM,
       CAST(month(date) % 2 = day(date) % 2 AS INTEGER) AS snap_AS,
       CAST(isodow(date) >= 6 AS INTEGER) AS snap_EU,
       CAST(day(date) <= month(date) AS INTEGER) AS snap_MI
FROM calendar CROSS JOIN bounds
""",
    "calendar",
    "bounds",
)


def wide_sales(t: DriverTables) -> DataFrame:
    """Daily sales with one column per day (``d_1`` is the first sales day).

    A series has one value per calendar day, so its array is bounded by the calendar; picking the
    columns out of it is much cheaper than a pivot with thousands of aggregates.
    """
    limits = t.ship_bounds.first()  # one row: how many day columns there are
    count = (limits["hi"] - limits["lo"]).days + 1
    days = F.array_sort(F.collect_list(F.struct("date", "quantity")))
    series = sales_grid(t).groupBy(*ENTITIES).agg(F.transform(days, lambda x: x["quantity"]).alias("q"))
    ids = ["product_id AS item_id", "product_id AS dept_id", "substring(product_id, 1, 1) AS cat_id", "store_id", "substring(store_id, 1, 2) AS state_id"]
    return series.selectExpr(*ids, *[f"get(q, {i}) AS d_{i + 1}" for i in range(count)])


def monthly_registry(t: DriverTables) -> DataFrame:
    """One registered dataset version per store and month of sales, with its fingerprint."""
    monthly = t.sales.withColumn("month", F.trunc("date", "month"))
    prints = content_fingerprint(monthly, by=("store_id", "month"))
    month = F.month("month")
    return prints.select(
        (F.year("month") * 12 + month).cast("bigint").alias("seq"),
        F.concat(F.lit("sales."), F.lower("store_id")).alias("dataset_id"),
        F.concat_ws(".", F.year("month"), month, F.lit("0")).alias("version"),
        F.lit("retail.sales").alias("schema_id"),
        F.when(month % 3 == 0, "derived").otherwise("reference").alias("source_type"),
        "row_count",
        "fingerprint",
    )


define(
    "monthly_prints",
    f"""
SELECT store_id, CAST(date_trunc('month', date) AS DATE) AS month, CAST(count(*) AS BIGINT) AS row_count,
       sha256('date:date,product_id:str,quantity:int|' || CAST(count(*) AS VARCHAR) || '|' || CAST(sum({sql_hash48("concat_ws(chr(31), 'v10:' || CAST(date AS VARCHAR), 'v' || length(product_id) || ':' || product_id, 'v' || length(CAST(quantity AS VARCHAR)) || ':' || CAST(quantity AS VARCHAR))")}) AS VARCHAR)) AS fingerprint
FROM sales GROUP BY ALL
""",
    "sales",
)
define(
    "registry",
    """
SELECT CAST(year(month) * 12 + month(month) AS BIGINT) AS seq, 'sales.' || lower(store_id) AS dataset_id,
       CAST(year(month) AS VARCHAR) || '.' || CAST(month(month) AS VARCHAR) || '.0' AS version, 'retail.sales' AS schema_id,
       CASE WHEN month(month) % 3 = 0 THEN 'derived' ELSE 'reference' END AS source_type, row_count, fingerprint
FROM monthly_prints
""",
    "monthly_prints",
)


def quarter_provenance(t: DriverTables) -> DataFrame:
    """Quarterly artifacts with their (at most three) monthly inputs pinned by fingerprint."""
    registry = monthly_registry(t)
    year, month = ((F.col("seq") - 1) / 12).cast("bigint"), (F.col("seq") - 1) % 12 + 1
    quarter = ((month - 1) / 3).cast("bigint") + 1
    entry = F.struct("dataset_id", "version", "fingerprint")
    grouped = registry.groupBy(F.concat("dataset_id", F.lit(".quarter")).alias("artifact"), F.concat_ws(".", year, quarter, F.lit("0")).alias("artifact_version")).agg(
        F.array_sort(F.collect_list(entry)).alias("inputs"), F.sum("row_count").alias("output_rows")
    )
    return grouped.select(
        F.col("artifact").alias("dataset_id"),
        F.col("artifact_version").alias("version"),
        "inputs",
        F.lit("quarter_rollup").alias("component"),
        F.lit("1.0.0").alias("component_version"),
        F.create_map(F.lit("grain"), F.lit("quarter")).alias("parameters"),
        F.lit(None).cast("string").alias("scenario_id"),
        hash48(F.concat_ws(":", "artifact", "artifact_version")).alias("seed"),
        F.array(F.lit("union"), F.lit("sum")).alias("steps"),
        F.sha2(F.array_join(F.transform("inputs", lambda x: x["fingerprint"]), "\n"), 256).alias("output_fingerprint"),
        "output_rows",
    )


define(
    "edges",
    """
SELECT dataset_id || '.quarter' AS dataset_id,
       CAST((seq - 1) // 12 AS VARCHAR) || '.' || CAST(((seq - 1) % 12) // 3 + 1 AS VARCHAR) || '.0' AS version,
       dataset_id AS input_id, version AS input_version, fingerprint AS pinned_fingerprint, row_count
FROM registry
""",
    "registry",
)


def stock_bounds(t: DriverTables):
    """First and last day with an order or a shipment, as scalar columns."""
    orders = t.raw("orders").select(F.col("o_orderdate").cast("date").alias("d")).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    lo = F.least(scalar(t.ship_bounds, "lo"), scalar(orders, "lo"))
    hi = F.greatest(scalar(t.ship_bounds, "hi"), scalar(orders, "hi"))
    return lo, hi


define(
    "stock_bounds",
    """
SELECT least(lo, (SELECT min(CAST(o_orderdate AS DATE)) FROM orders)) AS lo,
       greatest(hi, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS hi FROM bounds
""",
    "bounds",
)


def lead_items(t: DriverTables) -> DataFrame:
    """Lead time, cycle and service level per item (product, store)."""
    from stockweave.functions.random import seeded_uniform, uniform_between
    from stockweave.sources.drivertables import SEED

    lead = uniform_between(seeded_uniform(SEED, "item_lead", F.col("product_id"), F.col("store_id")), 4.0, 10.0, 2)
    return t.sales.select(*ENTITIES).distinct().select(
        *ENTITIES, lead.alias("lead_time_mean_days"), F.lit(14).cast("bigint").alias("order_cycle_days"), F.lit(0.95).alias("target_service_level")
    )


def movements(t: DriverTables) -> DataFrame:
    from stockweave.operators.ledger import fill_movements

    lo, hi = stock_bounds(t)
    return fill_movements(t.stock_moves, lo, hi)


def with_opening(moves: DataFrame, cover_days: object, by: tuple[str, ...] = ()) -> DataFrame:
    """Opening stock: ``cover_days`` of the item's mean daily demand."""
    from pyspark.sql import Window as W
    from stockweave.functions.numeric import as_column, round_half_even_int

    mean = F.avg("demand").over(W.partitionBy(*by, *ITEM))
    return moves.withColumn("opening_units", round_half_even_int(as_column(cover_days) * mean))


def single_ledger(t: DriverTables) -> DataFrame:
    from stockweave.operators.ledger import stock_ledger

    return stock_ledger(with_opening(movements(t), 14))


RUNS = {"baseline": 5, "stress": 6}  # demand in fifths


def variant_ledgers(t: DriverTables, wanted: tuple[str, ...] = tuple(RUNS)) -> DataFrame:
    """Ledgers on the same receipts: the wanted demand runs by three opening covers, in one pass."""
    from stockweave.operators.ledger import stock_ledger

    runs = F.array(*[F.struct(F.lit(r).alias("run_id"), F.lit(f).alias("fifths")) for r, f in RUNS.items() if r in wanted])
    covers = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(c).alias("cover")) for v, c in (("cover_07", 7), ("cover_14", 14), ("cover_28", 28))])
    tagged = movements(t).select("*", F.inline(runs)).select("*", F.inline(covers))
    opened = with_opening(tagged, F.col("cover"), ("run_id", "variant"))
    scaled = opened.withColumn("demand", F.floor(F.col("demand") * F.col("fifths") / 5).cast("bigint"))
    key = ("run_id", "variant", *ITEM)
    return stock_ledger(scaled, item=key)
