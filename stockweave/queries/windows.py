"""Queries of section E (windows) on series, keys and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions.numeric import stable6
from stockweave.operators import windows as Win
from stockweave.plans import planning as P
from stockweave.queries import inputs as I
from stockweave.queries.forecasting import backtest_of
from stockweave.queries.inputs import ENTITIES
from stockweave.queries.registry import query
from stockweave.queries.sqlparts import r6, with_ctes


@query("first_sale_trim", with_ctes("grid first_sale", "SELECT date, product_id, store_id, quantity FROM grid JOIN first_sale USING (product_id, store_id) WHERE date >= first"))
def first_sale_trim(t):
    return Win.first_sale_trim(I.sales_grid(t), ENTITIES).select("date", *ENTITIES, "quantity")


_OVER = "OVER (PARTITION BY product_id, store_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query(
    "trailing_mean",
    with_ctes("grid", "SELECT date, product_id, store_id, " + ", ".join(f"{r6('avg(quantity) ' + _OVER.format(n=n))} AS mean_{n}" for n in (7, 28, 365)) + " FROM grid"),
)
def trailing_mean(t):
    means = Win.trailing_means(I.sales_grid(t), ENTITIES, (7, 28, 365))
    return means.select("date", *ENTITIES, *[stable6(F.col(f"mean_{n}")).alias(f"mean_{n}") for n in (7, 28, 365)])


@query(
    "same_weekday_mean4",
    with_ctes("grid", f"SELECT date, product_id, store_id, {r6('avg(quantity) OVER (PARTITION BY product_id, store_id, isodow(date) ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS mean_same_weekday_4 FROM grid"),
)
def same_weekday_mean4(t):
    means = Win.same_weekday_mean(I.sales_grid(t), ENTITIES)
    return means.select("date", *ENTITIES, stable6(F.col("mean_same_weekday_4")).alias("mean_same_weekday_4"))


@query("last_value_before", with_ctes("grid", "SELECT date, product_id, store_id, lag(quantity) OVER (PARTITION BY product_id, store_id ORDER BY date) AS last_value FROM grid"))
def last_value_before(t):
    return Win.last_value_before(I.sales_grid(t), ENTITIES).select("date", *ENTITIES, "last_value")


@query(
    "latest_origin_per_date",
    with_ctes("fc_seasonal_naive", f"""SELECT product_id, store_id, date, origin_date, {r6('forecast')} AS forecast FROM fc_seasonal_naive
    WHERE origin_date <= date QUALIFY row_number() OVER (PARTITION BY product_id, store_id, date ORDER BY origin_date DESC) = 1"""),
)
def latest_origin_per_date(t):
    rows = Win.latest_origin_per_date(backtest_of(t, "seasonal_naive").drop("actual"), ENTITIES)
    return rows.select(*ENTITIES, "date", "origin_date", stable6(F.col("forecast")).alias("forecast"))


@query("duplicate_rank", "SELECT l_orderkey, l_linenumber, CAST(count(*) - 1 AS BIGINT) AS extra_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_rank(t):
    return Win.duplicate_counts(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("distributed_rank", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def distributed_rank(t):
    orders = t.raw("orders").select("o_orderkey", "o_totalprice")
    return Win.distributed_rank(orders, [F.col("o_totalprice"), F.col("o_orderkey")])


@query(
    "sequence_ids",
    """SELECT c_custkey, c_mktsegment, 'C' || CASE WHEN r < 10000 THEN lpad(CAST(r AS VARCHAR), 5, '0') ELSE CAST(r AS VARCHAR) END AS customer_id
       FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS r FROM customer)""",
)
def sequence_ids(t):
    customers = t.raw("customer").select("c_custkey", "c_mktsegment")
    return Win.sequence_ids(customers, [F.col("c_mktsegment"), F.col("c_custkey")], "customer_id", prefix="C", width=5)


@query(
    "review_schedule",
    with_ctes("calendar bounds", "SELECT date, CAST(date - lo AS BIGINT) AS day_index, (date - lo) % 7 = 0 AS is_review, (date - lo) % 14 = 0 AS is_order_day FROM calendar CROSS JOIN bounds"),
)
def review_schedule(t):
    return P.review_days(t.calendar.select("date"), I.scalar(t.ship_bounds, "lo"), 7, 14)
