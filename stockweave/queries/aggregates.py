"""Queries of section D (aggregations) on demand history and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions.numeric import round_half_even, stable6
from stockweave.operators import aggregates as A
from stockweave.operators import fingerprint as FP
from stockweave.operators import spine
from stockweave.plans import calibrate, state
from stockweave.plans import forecast as fc
from stockweave.plans import planning as P
from stockweave.queries import inputs as I
from stockweave.queries.forecasting import ACCURACY_SQL, backtest_of, stable_accuracy
from stockweave.queries.inputs import ENTITIES
from stockweave.queries.joins import mean_daily, recent_days
from stockweave.queries.registry import query
from stockweave.queries.sqlparts import define, even, r6, with_ctes
from stockweave.sources import versions
from stockweave.sources.files import scratch_path


@query("avg_price_per_product", with_ctes("price", f"SELECT product_id, {even('avg(unit_price)', 4)} AS avg_unit_price FROM price GROUP BY ALL"))
def avg_price_per_product(t):
    return A.mean_price(t.price)


@query("store_demand_sum", with_ctes("mean_daily", f"SELECT store_id, {r6('sum(mean_daily_demand)')} AS mean_daily_demand FROM mean_daily GROUP BY ALL"))
def store_demand_sum(t):
    return A.store_demand(mean_daily(t)).withColumn("mean_daily_demand", stable6(F.col("mean_daily_demand")))


@query("mean_daily_demand", with_ctes("mean_daily", "SELECT product_id, store_id, mean_daily_demand FROM mean_daily"))
def mean_daily_demand(t):
    return mean_daily(t)


define(
    "history_mean",
    """SELECT product_id, store_id, avg(quantity) AS mean_demand FROM sales JOIN
(SELECT product_id, store_id, min(date) AS first, max(date) AS last FROM sales GROUP BY ALL) USING (product_id, store_id)
WHERE date >= greatest(first, last - 364) GROUP BY ALL""",
    "sales",
)


@query("active_history_mean", with_ctes("history_mean", f"SELECT product_id, store_id, {r6('mean_demand')} AS mean_demand FROM history_mean"))
def active_history_mean(t):
    return A.active_history_mean(t.sales, 365).withColumn("mean_demand", stable6(F.col("mean_demand")))


@query(
    "entity_counts",
    """SELECT 'l_orderkey' AS entity_key, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS distinct_values FROM lineitem
       UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem""",
)
def entity_counts(t):
    return A.entity_counts(t.raw("lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])


@query("time_range", "SELECT CAST(min(l_shipdate) AS DATE) AS range_start, CAST(max(l_shipdate) AS DATE) AS range_end FROM lineitem")
def time_range(t):
    return A.time_range(t.raw("lineitem").select(F.col("l_shipdate").cast("date").alias("d")), "d")


_NUMBERS = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
            "l_extendedprice": "double", "l_discount": "double", "l_tax": "double"}
_PROFILE_SQL = "\nUNION ALL ".join(
    [
        f"""SELECT '{c}' AS "column", '{k}' AS dtype, CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS null_count, CAST(min({c}) AS DOUBLE) AS min_number, CAST(max({c}) AS DOUBLE) AS max_number,
        CAST(NULL AS VARCHAR) AS min_date, CAST(NULL AS VARCHAR) AS max_date, {even(f'avg({c})', 4)} AS mean FROM lineitem"""
        for c, k in _NUMBERS.items()
    ]
    + [
        f"SELECT '{c}', 'string', count(*) FILTER ({c} IS NULL), NULL, NULL, NULL, NULL, NULL FROM lineitem"
        for c in ("l_returnflag", "l_linestatus")
    ]
    + ["SELECT 'ship_day', 'date', count(*) FILTER (l_shipdate IS NULL), NULL, NULL, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR), CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR), NULL FROM lineitem"]
)


@query("column_profile", _PROFILE_SQL)
def column_profile(t):
    lines = t.raw("lineitem").withColumn("ship_day", F.col("l_shipdate").cast("date")).drop("l_shipdate")
    return A.column_profile(lines).withColumn("mean", round_half_even(F.col("mean"), 4))


@query("grid_sum", with_ctes("lines", "SELECT date, product_id, store_id, CAST(sum(quantity) AS BIGINT) AS quantity FROM lines GROUP BY ALL"))
def grid_sum(t):
    return spine.grid_sum(t.lines, "date", ENTITIES, "quantity")


@query("series_sum_by_date", with_ctes("sales", "SELECT date, CAST(sum(quantity) AS BIGINT) AS quantity FROM sales WHERE store_id = 'ASIA' GROUP BY ALL"))
def series_sum_by_date(t):
    from stockweave.operators.select import filter_entities

    return A.series_sum_by_date(filter_entities(t.sales, {"store_id": "ASIA"}), "date", "quantity")


@query("forecast_accuracy", with_ctes("bt_moving_average", f"SELECT {ACCURACY_SQL} FROM bt_moving_average"))
def forecast_accuracy(t):
    return stable_accuracy(fc.forecast_accuracy(backtest_of(t, "moving_average")))


@query(
    "demand_stats",
    with_ctes("grid", f""", daily AS (SELECT date, CAST(sum(quantity) AS BIGINT) AS total FROM grid GROUP BY ALL)
SELECT CAST((SELECT count(*) FROM daily) AS BIGINT) AS days, {r6('avg(quantity)')} AS mean_units,
 {r6('sum(quantity) / CAST(count(*) FILTER (quantity > 0) AS DOUBLE)')} AS mean_selling_day,
 (SELECT {r6('stddev_samp(total) / avg(total)')} FROM daily) AS cv_daily_total,
 {r6('count(*) FILTER (quantity = 0) / CAST(count(*) AS DOUBLE)')} AS zero_share,
 CAST((SELECT count(*) FROM (SELECT DISTINCT product_id, store_id FROM grid)) AS BIGINT) AS series FROM grid"""),
)
def demand_stats(t):
    stats = A.demand_stats(I.sales_grid(t), ENTITIES)
    return stats.withColumns({c: stable6(F.col(c)) for c in ("mean_units", "mean_selling_day", "cv_daily_total", "zero_share")})


@query(
    "weekday_index",
    with_ctes("grid", f"SELECT isodow(date) - 1 AS weekday, {even('avg(quantity) / (SELECT avg(quantity) FROM grid)', 3)} AS weekday_index FROM grid GROUP BY ALL"),
)
def weekday_index(t):
    return A.weekday_index(I.sales_grid(t))


@query(
    "item_mean_correlation",
    with_ctes("grid bounds", f""", a AS (SELECT product_id, avg(quantity) AS x FROM grid WHERE date <= (SELECT hi - 365 FROM bounds) GROUP BY ALL),
b AS (SELECT product_id, avg(quantity) AS y FROM grid WHERE date > (SELECT hi - 365 FROM bounds) GROUP BY ALL)
SELECT {r6('corr(x, y)')} AS correlation, CAST(count(*) AS BIGINT) AS items FROM a JOIN b USING (product_id)"""),
)
def item_mean_correlation(t):
    grid, cut = I.sales_grid(t), F.date_sub(I.scalar(t.ship_bounds, "hi"), 365)
    result = A.item_mean_correlation(grid.where(F.col("date") <= cut), grid.where(F.col("date") > cut), "product_id", "quantity")
    return result.withColumn("correlation", stable6(F.col("correlation")))


@query(
    "error_std",
    with_ctes("in_use recent_days", f"""SELECT d.product_id, d.store_id, d.day, CAST(count(e.error) AS BIGINT) AS errors, CASE WHEN count(e.error) >= 2 THEN {r6('stddev_samp(e.error)')} END AS error_std
    FROM recent_days d LEFT JOIN in_use e ON e.product_id = d.product_id AND e.store_id = d.store_id AND e.date >= d.day - 56 AND e.date < d.day GROUP BY ALL"""),
)
def error_std(t):
    errors = P.errors_in_use(backtest_of(t, "seasonal_naive"), ENTITIES)
    return P.error_std(recent_days(t), errors, ENTITIES, 56).select(*ENTITIES, "day", "errors", stable6(F.col("error_std")).alias("error_std"))


@query("content_fingerprint", with_ctes("monthly_prints", "SELECT * FROM monthly_prints"))
def content_fingerprint(t):
    return FP.content_fingerprint(t.sales.withColumn("month", F.trunc("date", "month")), by=("store_id", "month"))


_LINE = "store_id || strftime(month, '%Y-%m') || '=' || fingerprint"


@query("bundle_fingerprint", with_ctes("monthly_prints", f"SELECT CAST(year(month) AS BIGINT) AS year, sha256(string_agg({_LINE}, chr(10) ORDER BY {_LINE})) AS bundle_fingerprint FROM monthly_prints GROUP BY ALL"))
def bundle_fingerprint(t):
    prints = content_fingerprint(t)
    named = prints.select(F.year("month").cast("bigint").alias("year"), F.concat("store_id", F.date_format("month", "yyyy-MM")).alias("name"), "fingerprint")
    return FP.bundle_fingerprint(named, by=("year",))


@query("distinct_dims", with_ctes("ids", "SELECT DISTINCT item_id, dept_id, cat_id, store_id, state_id FROM ids"))
def distinct_dims(t):
    return I.series_ids(t).distinct()


# Weekday and month factors of the last 730 days, leading zeros left out; factors rounded to 6 places.
def _profile_ctes(p: str, start: str) -> None:
    """Level, factors and dispersion of active history from ``start`` on; names begin with ``p``."""
    define(
        f"{p}active",
        f"SELECT g.product_id, g.store_id, g.date, CAST(quantity AS DOUBLE) AS y FROM grid g JOIN first_sale USING (product_id, store_id) WHERE g.date >= greatest(first, (SELECT {start} FROM bounds))",
        "grid", "first_sale", "bounds",
    )
    define(f"{p}level", f"SELECT product_id, store_id, avg(y) AS level FROM {p}active GROUP BY ALL", f"{p}active")
    for name, key, count, first in (("weekly", "isodow(date) - 1", 7, 0), ("monthly", "month(date)", 12, 1)):
        define(
            f"{p}{name}",
            f"""
SELECT l.product_id, l.store_id, k AS key, {even('coalesce(m / level / scale, 1.0)', 6)} AS factor
FROM {p}level l CROSS JOIN (SELECT unnest(generate_series({first}, {first + count - 1})) AS k)
LEFT JOIN (SELECT product_id, store_id, {key} AS key, avg(y) AS m FROM {p}active GROUP BY ALL) w ON w.product_id = l.product_id AND w.store_id = l.store_id AND w.key = k
JOIN (SELECT product_id, store_id, avg(m / level) AS scale FROM (SELECT product_id, store_id, {key} AS key, avg(y) AS m FROM {p}active GROUP BY ALL) JOIN {p}level USING (product_id, store_id) GROUP BY ALL) s
  ON s.product_id = l.product_id AND s.store_id = l.store_id""",
            f"{p}level",
        )
    define(
        f"{p}moments",
        f"""
SELECT product_id, store_id, sum(fit * fit) AS squares, sum((y - fit) * (y - fit) - fit) AS excess FROM (
  SELECT a.product_id, a.store_id, y, level * w.factor * m.factor AS fit FROM {p}active a JOIN {p}level l ON l.product_id = a.product_id AND l.store_id = a.store_id
  JOIN {p}weekly w ON w.product_id = a.product_id AND w.store_id = a.store_id AND w.key = isodow(a.date) - 1
  JOIN {p}monthly m ON m.product_id = a.product_id AND m.store_id = a.store_id AND m.key = month(a.date)) GROUP BY ALL
""",
        f"{p}active", f"{p}level", f"{p}weekly", f"{p}monthly",
    )
    define(
        f"{p}profiles",
        f"SELECT product_id, store_id, {even('level', 6)} AS level, {even('CASE WHEN excess > 0 THEN least(greatest(squares / excess, 0.05), 1e6) ELSE 1e6 END', 6)} AS dispersion FROM {p}level JOIN {p}moments USING (product_id, store_id)",
        f"{p}level", f"{p}moments",
    )


_profile_ctes("", "hi - 729")
_profile_ctes("whole_month_", "date_trunc('month', hi - 729)")


def calibrated(t):
    return calibrate.calibrate_profiles(I.sales_grid(t), ENTITIES, I.scalar(t.ship_bounds, "hi"))


def factors(t):
    return calibrate.seasonal_factors(calibrate.seasonal_cells(I.sales_grid(t), ENTITIES, I.scalar(t.ship_bounds, "hi")), ENTITIES)


@query("weekly_factors", with_ctes("weekly", "SELECT product_id, store_id, CAST(key AS BIGINT) AS weekday, factor FROM weekly"))
def weekly_factors(t):
    return factors(t).select(*ENTITIES, F.posexplode("weekly").alias("weekday", "factor")).withColumn("weekday", F.col("weekday").cast("bigint"))


@query("monthly_factors", with_ctes("monthly", "SELECT product_id, store_id, CAST(key AS BIGINT) AS month, factor FROM monthly"))
def monthly_factors(t):
    return factors(t).select(*ENTITIES, F.posexplode("monthly").alias("month", "factor")).withColumn("month", (F.col("month") + 1).cast("bigint"))


@query("dispersion_moments", with_ctes("profiles", "SELECT product_id, store_id, dispersion FROM profiles"))
def dispersion_moments(t):
    return calibrated(t).select(*ENTITIES, "dispersion")


@query(
    "calibrate_profiles",
    with_ctes("profiles weekly monthly", f"""SELECT product_id, store_id, level, dispersion,
    (SELECT {r6('sum(factor * (key + 1))')} FROM weekly w WHERE w.product_id = p.product_id AND w.store_id = p.store_id) AS weekly_moment,
    (SELECT {r6('sum(factor * key)')} FROM monthly m WHERE m.product_id = p.product_id AND m.store_id = p.store_id) AS monthly_moment FROM profiles p"""),
)
def calibrate_profiles(t):
    return profile_moments(calibrated(t))


def profile_moments(profiles):
    weighted = lambda c: F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return profiles.select(*ENTITIES, "level", "dispersion", stable6(weighted("weekly")).alias("weekly_moment"), stable6(weighted("monthly")).alias("monthly_moment"))


@query(
    "calibrate_incremental",
    with_ctes("whole_month_profiles whole_month_weekly whole_month_monthly", f"""SELECT product_id, store_id, level, dispersion,
    (SELECT {r6('sum(factor * (key + 1))')} FROM whole_month_weekly w WHERE w.product_id = p.product_id AND w.store_id = p.store_id) AS weekly_moment,
    (SELECT {r6('sum(factor * key)')} FROM whole_month_monthly m WHERE m.product_id = p.product_id AND m.store_id = p.store_id) AS monthly_moment FROM whole_month_profiles p"""),
)
def calibrate_incremental(t):
    """Profiles of the last two years from stored month cells; the last month is added to what was stored before it."""
    root, grid, hi = scratch_path(t.spark, "month-cells"), I.sales_grid(t), I.scalar(t.ship_bounds, "hi")
    last = F.trunc(hi, "month")
    state.add_months(grid.where(F.col("date") < last), root, ENTITIES)
    state.add_months(grid.where(F.col("date") >= last), root, ENTITIES)
    return profile_moments(state.profiles_from_cells(versions.read(t.spark, root), ENTITIES, F.date_sub(hi, 729)))
