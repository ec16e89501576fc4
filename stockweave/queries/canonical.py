"""Queries of section L (source layout to canonical retail tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.operators import spine
from stockweave.queries import inputs as I
from stockweave.queries.registry import query
from stockweave.queries.sqlparts import with_ctes
from stockweave.sources import retail

NAMES = {"AM": "Americas", "EU": "Europe"}


@query("build_region", with_ctes("ids", "SELECT DISTINCT state_id AS region_id, CASE state_id WHEN 'AM' THEN 'Americas' WHEN 'EU' THEN 'Europe' ELSE state_id END AS name FROM ids"))
def build_region(t):
    return retail.build_region(I.series_ids(t), NAMES)


@query("build_store", with_ctes("ids", "SELECT DISTINCT store_id, state_id AS region_id FROM ids"))
def build_store(t):
    return retail.build_store(I.series_ids(t))


@query("build_category_department", with_ctes("ids", "SELECT DISTINCT dept_id AS department_id, cat_id AS category_id FROM ids"))
def build_category_department(t):
    departments = retail.build_department(I.series_ids(t))
    return departments.join(retail.build_category(I.series_ids(t)), "category_id").select("department_id", "category_id")


@query("build_product", with_ctes("ids", "SELECT DISTINCT item_id AS product_id, dept_id AS department_id, cat_id AS category_id FROM ids"))
def build_product(t):
    return retail.build_product(I.series_ids(t))


@query("build_calendar", with_ctes("calendar", "SELECT date, week_id, weekday, month, year FROM calendar"))
def build_calendar(t):
    return retail.build_calendar(I.calendar_source(t))


_EVENTS = """SELECT date, event_name_1 AS event_name, event_type_1 AS event_type FROM calendar_source WHERE event_name_1 IS NOT NULL
UNION ALL SELECT date, event_name_2, event_type_2 FROM calendar_source WHERE event_name_2 IS NOT NULL"""


@query("build_calendar_event", with_ctes("calendar_source", _EVENTS))
def build_calendar_event(t):
    return retail.build_calendar_event(I.calendar_source(t))


_SNAP = "\nUNION ALL ".join(f"SELECT date, '{r}' AS region_id, snap_{r} = 1 AS snap_active FROM calendar_source" for r in I.SNAP_REGIONS)


@query("build_calendar_snap", with_ctes("calendar_source", _SNAP))
def build_calendar_snap(t):
    return retail.build_calendar_snap(I.calendar_source(t), I.SNAP_REGIONS)


@query("build_sales", with_ctes("grid", "SELECT date, product_id, store_id, quantity FROM grid"))
def build_sales(t):
    return retail.build_sales(I.wide_sales(t), I.calendar_source(t))


@query("build_price", with_ctes("price", "SELECT week_id, product_id, store_id, unit_price FROM price WHERE store_id IN ('ASIA', 'EUROPE')"))
def build_price(t):
    prices = t.price.select(F.col("week_id").alias("wm_yr_wk"), F.col("product_id").alias("item_id"), "store_id", F.col("unit_price").alias("sell_price"))
    sold = retail.filter_isin(t.sales, store_id=["ASIA", "EUROPE"]).select(F.col("product_id").alias("item_id"), "store_id")
    return retail.build_price(prices, sold)


@query(
    "event_calendar",
    with_ctes("calendar_source", """SELECT date, event_name_1 AS event_name, event_type_1 AS event_type FROM calendar_source WHERE event_name_1 IS NOT NULL
    UNION ALL SELECT date, 'SecondFeast', 'Religious' FROM calendar_source WHERE date = DATE '1998-12-25'"""),
)
def event_calendar(t):
    days = spine.date_spine(t.ship_bounds, F.col("lo"), F.col("hi"))
    return retail.event_calendar(days, extra=[("1998-12-25", "SecondFeast", "Religious")])
