"""Queries of sections F (sorts), G (set operations) and H (reshape)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.operators import sets as S
from stockweave.plans import calibrate, synth
from stockweave.queries import inputs as I
from stockweave.queries.aggregates import calibrated
from stockweave.queries.inputs import ENTITIES
from stockweave.queries.registry import query
from stockweave.queries.sqlparts import define, with_ctes
from stockweave.sources import retail


@query("sort_by_primary_key", with_ctes("sales", "SELECT date, product_id, store_id, quantity FROM sales ORDER BY ALL"))
def sort_by_primary_key(t):
    return S.sort_by_key(t.sales, ["date", *ENTITIES])


@query("top_n_items", with_ctes("ids", "SELECT item_id, CAST(count(*) AS BIGINT) AS units FROM ids GROUP BY ALL ORDER BY units DESC, item_id LIMIT 10"))
def top_n_items(t):
    return retail.top_items(I.series_ids(t).withColumn("quantity", F.lit(1)), 10)


@query("preview_head", with_ctes("sales", "SELECT CAST(to_json({'date': CAST(date AS VARCHAR), 'product_id': product_id, 'store_id': store_id, 'quantity': quantity}) AS VARCHAR) AS record FROM (SELECT * FROM sales ORDER BY date, product_id, store_id LIMIT 20)"))
def preview_head(t):
    return S.preview(t.sales.select("date", *ENTITIES, "quantity"), ["date", *ENTITIES], 20)


@query("runs_newest_first", with_ctes("registry", "SELECT seq, dataset_id, version, row_count FROM registry"))
def runs_newest_first(t):
    return S.newest_first(I.monthly_registry(t).select("seq", "dataset_id", "version", "row_count"), "seq")


# Expected demand of the 91 days after the history, per scenario (no noise).
define(
    "scenarios",
    """SELECT * FROM (VALUES ('baseline', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 0, 0), ('high_demand', 1.3::DOUBLE, 1.2::DOUBLE, 1.0::DOUBLE, 0, 0),
('demand_shock', 1.0::DOUBLE, 1.0::DOUBLE, 2.5::DOUBLE, 28, 14), ('supply_disruption', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 0, 0)) s(scenario_id, lvl, seas, shock, s0, sn)""",
)
define(
    "expected",
    """
SELECT scenario_id, product_id, store_id, date, day_index, rate, season < 0 AS season_clipped, CAST(round_even(rate, 0) AS BIGINT) AS quantity FROM (
  SELECT *, level * greatest(season, 0.0) * 1.0 * lvl * CASE WHEN day_index >= s0 AND day_index < s0 + sn THEN shock ELSE 1.0 END AS rate FROM (
    SELECT s.*, p.product_id, p.store_id, level, d.date, d.day_index, 1.0 + seas * (w.factor * m.factor - 1.0) AS season
    FROM profiles p CROSS JOIN scenarios s CROSS JOIN (SELECT CAST(n AS BIGINT) AS day_index, CAST(hi + 1 + CAST(n AS INTEGER) AS DATE) AS date FROM bounds CROSS JOIN (SELECT unnest(generate_series(0, 90)) AS n)) d
    JOIN weekly w ON w.product_id = p.product_id AND w.store_id = p.store_id AND w.key = isodow(d.date) - 1
    JOIN monthly m ON m.product_id = p.product_id AND m.store_id = p.store_id AND m.key = month(d.date)))
""",
    "profiles", "weekly", "monthly", "scenarios", "bounds",
)


def horizon_start(t):
    return F.date_add(I.scalar(t.ship_bounds, "hi"), 1)


def expected_rows(t, effects=None):
    days = calibrate.profile_days(calibrated(t), horizon_start(t), 91)
    return calibrate.expected_demand(days, calibrate.effect_columns(effects or calibrate.Effects()))


@query(
    "union_timeline",
    with_ctes("sales expected", """, horizon AS (SELECT date, product_id, store_id, quantity FROM expected WHERE scenario_id = 'baseline' AND store_id <> 'AFRICA')
SELECT date, product_id, store_id, quantity, 'observed' AS origin FROM sales WHERE (product_id, store_id) IN (SELECT (product_id, store_id) FROM horizon)
UNION ALL SELECT date, product_id, store_id, quantity, 'synthetic' FROM horizon"""),
)
def union_timeline(t):
    horizon = expected_rows(t).where("store_id <> 'AFRICA'").withColumn("quantity", F.col("expected"))
    return synth.union_timeline(t.sales, horizon, ENTITIES)


@query(
    "union_event_columns",
    with_ctes("calendar_source", """SELECT event_type_1 AS event_type, event_name_1 AS event_name, CAST(count(*) AS BIGINT) AS days FROM calendar_source WHERE event_name_1 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT event_type_2, event_name_2, count(*) FROM calendar_source WHERE event_name_2 IS NOT NULL GROUP BY ALL"""),
)
def union_event_columns(t):
    events = retail.build_calendar_event(I.calendar_source(t))
    return events.groupBy("event_type", "event_name").agg(F.count(F.lit(1)).alias("days"))


@query("overlap_names", "SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_partkey IN (SELECT user_id FROM events)")
def overlap_names(t):
    return S.overlap(t.raw("lineitem").select(F.col("l_partkey").alias("key")), t.raw("events").select(F.col("user_id").alias("key")))


@query("except_keys", "SELECT DISTINCT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT user_id FROM events)")
def except_keys(t):
    return S.only_in_first(t.raw("part").select(F.col("p_partkey").alias("key")), t.raw("events").select(F.col("user_id").alias("key")))


@query("dedupe", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def dedupe(t):
    return t.raw("lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()


@query("unpivot_daily_sales", with_ctes("grid bounds", "SELECT product_id AS item_id, store_id, 'd_' || CAST(date - lo + 1 AS VARCHAR) AS d, quantity FROM grid CROSS JOIN bounds"))
def unpivot_daily_sales(t):
    return retail.unpivot_days(I.wide_sales(t), ["item_id", "store_id"])


_SNAP_COUNTS = " UNION ALL ".join(f"SELECT '{r}' AS region_id, year, CAST(sum(snap_{r}) AS BIGINT) AS active_days, CAST(count(*) AS BIGINT) AS days FROM calendar_source GROUP BY ALL" for r in I.SNAP_REGIONS)


@query("snap_to_rows", with_ctes("calendar_source", _SNAP_COUNTS))
def snap_to_rows(t):
    rows = retail.build_calendar_snap(I.calendar_source(t), I.SNAP_REGIONS)
    return rows.groupBy("region_id", F.year("date").cast("bigint").alias("year")).agg(F.count_if("snap_active").alias("active_days"), F.count(F.lit(1)).alias("days"))
