"""Queries of section M (rolling-origin forecasts) and the spines they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions.numeric import stable6
from stockweave.operators import spine
from stockweave.plans import forecast as fc
from stockweave.queries.inputs import ENTITIES, sales_grid
from stockweave.queries.registry import query
from stockweave.queries.sqlparts import define, r6, with_ctes
from stockweave.sources.drivertables import DriverTables

SPEC = fc.ForecastSpec(ENTITIES)


def origin_range(t: DriverTables) -> fc.OriginRange:
    lo, hi = t.ship_bounds.select("lo").scalar(), t.ship_bounds.select("hi").scalar()
    return fc.OriginRange(F.date_sub(hi, 90), hi, lo, hi)


def forecast_of(t: DriverTables, model: str, grid=None, trace: bool = False):
    grid = sales_grid(t) if grid is None else grid
    if model == "learned":
        return fc.learned_forecast(grid, SPEC, t.ship_bounds, origin_range(t), trace=trace)
    make = {"moving_average": fc.moving_average_forecast, "seasonal_naive": fc.seasonal_naive_forecast}[model]
    return make(grid, SPEC, origin_range(t), trace=trace)


def backtest_of(t: DriverTables, model: str, grid=None):
    grid = sales_grid(t) if grid is None else grid
    return fc.attach_actuals(forecast_of(t, model, grid), grid, SPEC)


@query("date_spine", with_ctes("calendar", "SELECT date FROM calendar"))
def date_spine(t):
    return spine.date_spine(t.ship_bounds, F.col("lo"), F.col("hi"))


@query("origin_spine", with_ctes("origins", "SELECT origin_date FROM origins"))
def origin_spine(t):
    return spine.origin_spine(t.ship_bounds, F.date_sub("hi", 90), F.col("hi"), 7)


@query("observed_grid", with_ctes("grid", "SELECT date, product_id, store_id, quantity, observed FROM grid"))
def observed_grid(t):
    return sales_grid(t)


for _model in ("moving_average", "seasonal_naive"):
    query(
        f"forecast_{_model}",
        with_ctes(f"fc_{_model}", f"SELECT origin_date, date, product_id, store_id, {r6('forecast')} AS forecast FROM fc_{_model}"),
    )(lambda t, m=_model: forecast_of(t, m).withColumn("forecast", stable6(F.col("forecast"))))


def both_models(t, grid=None):
    """Backtests of both baseline models, tagged by model."""
    grid = sales_grid(t) if grid is None else grid
    tagged = [forecast_of(t, m, grid).withColumn("model", F.lit(m)) for m in ("moving_average", "seasonal_naive")]
    return fc.attach_actuals(tagged[0].unionByName(tagged[1]), grid, SPEC)


define("bt_both", "SELECT 'moving_average' AS model, * FROM bt_moving_average UNION ALL SELECT 'seasonal_naive', * FROM bt_seasonal_naive", "bt_moving_average", "bt_seasonal_naive")


@query("rolling_backtest", with_ctes("bt_both", f"SELECT model, origin_date, date, product_id, store_id, {r6('forecast')} AS forecast, actual FROM bt_both"))
def rolling_backtest(t):
    return both_models(t).select("model", "origin_date", "date", *ENTITIES, stable6(F.col("forecast")).alias("forecast"), "actual")


ACCURACY_SQL = f"""CAST(count(actual) AS BIGINT) AS forecast_rows_evaluated, {r6('avg(abs(forecast - actual))')} AS mae,
{r6('sqrt(avg((forecast - actual) * (forecast - actual)))')} AS rmse,
{r6('CASE WHEN sum(actual) > 0 THEN sum(abs(forecast - actual)) / sum(actual) END')} AS wape,
{r6('CASE WHEN sum(actual) > 0 THEN sum(CASE WHEN actual IS NOT NULL THEN forecast - actual END) / sum(actual) END')} AS bias"""


def stable_accuracy(df):
    return df.withColumns({m: stable6(F.col(m)) for m in ("mae", "rmse", "wape", "bias")})


@query("backtest_accuracy", with_ctes("bt_both", f"SELECT model, origin_date, product_id, store_id, {ACCURACY_SQL} FROM bt_both GROUP BY GROUPING SETS ((), (model), (model, origin_date), (model, product_id, store_id))"))
def backtest_accuracy(t):
    return stable_accuracy(fc.grouped_accuracy(both_models(t), SPEC))


_FEATURE_NUMBERS = ("mean_7", "mean_28", "mean_365", "mean_same_weekday_4")
define(
    "known",
    """SELECT date AS anchor, product_id, store_id, CAST(quantity AS DOUBLE) AS last_value,
avg(quantity) OVER (PARTITION BY product_id, store_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS mean_7,
avg(quantity) OVER (PARTITION BY product_id, store_id ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS mean_28,
avg(quantity) OVER (PARTITION BY product_id, store_id ORDER BY date ROWS BETWEEN 364 PRECEDING AND CURRENT ROW) AS mean_365,
avg(quantity) OVER (PARTITION BY product_id, store_id, isodow(date) ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS mean_weekday FROM grid""",
    "grid",
)
_FEATURES = """SELECT o.origin_date, o.date, k.product_id, k.store_id, o.h AS horizon_day, CAST(isodow(o.date) - 1 AS BIGINT) AS weekday, CAST(month(o.date) AS BIGINT) AS month,
k.last_value, k.mean_7, k.mean_28, k.mean_365, coalesce(w.mean_weekday, k.mean_28) AS mean_same_weekday_4
FROM (SELECT origin_date, anchor, h, CAST(origin_date + CAST(h AS INTEGER) AS DATE) AS date FROM {anchors} CROSS JOIN horizon) o
JOIN known k ON k.anchor = o.anchor
LEFT JOIN known w ON w.product_id = k.product_id AND w.store_id = k.store_id AND w.anchor = o.anchor - CAST((isodow(o.anchor) - isodow(o.date) + 7) % 7 AS INTEGER)"""
define("features", _FEATURES.format(anchors="anchors"), "anchors", "horizon", "known")
define(
    "training_anchors",
    """SELECT CAST(o AS DATE) AS origin_date, CAST(o AS DATE) - 1 AS anchor FROM (SELECT unnest(generate_series(hi - 118, CAST(greatest(lo + 28, hi - 90 - 730) AS TIMESTAMP), INTERVAL (-7) DAY)) AS o FROM bounds)""",
    "bounds",
)
define("training_features", _FEATURES.format(anchors="training_anchors"), "training_anchors", "horizon", "known")


def stable_features(df):
    return df.withColumns({c: stable6(F.col(c)) for c in _FEATURE_NUMBERS})


def _feature_columns(alias: str = "") -> str:
    return ", ".join(f"{r6(f'{alias}{c}')} AS {c}" for c in _FEATURE_NUMBERS)


@query("forecast_features", with_ctes("features", f"SELECT origin_date, date, product_id, store_id, horizon_day, weekday, month, last_value, {_feature_columns()} FROM features"))
def forecast_features(t):
    origins = spine.origin_spine(t.ship_bounds, F.date_sub("hi", 90), F.col("hi"), 7)
    return stable_features(fc.forecast_features(sales_grid(t), SPEC, origins, t.ship_bounds.select("hi").scalar()))


def learning_start(t):
    return F.date_sub(t.ship_bounds.select("hi").scalar(), 90)


@query(
    "training_set",
    with_ctes("training_features grid", f"SELECT f.origin_date, f.date, f.product_id, f.store_id, horizon_day, weekday, month, last_value, {_feature_columns('f.')}, CAST(g.quantity AS DOUBLE) AS target FROM training_features f JOIN grid g ON g.date = f.date AND g.product_id = f.product_id AND g.store_id = f.store_id"),
)
def training_set(t):
    rows = stable_features(fc.training_set(sales_grid(t), SPEC, t.ship_bounds, learning_start(t)))
    return rows.select("origin_date", "date", *ENTITIES, "horizon_day", "weekday", "month", "last_value", *_FEATURE_NUMBERS, "target")


@query("forecast_ml")
def forecast_ml(t):
    grid = sales_grid(t)
    predicted = fc.learned_forecast(grid, SPEC, t.ship_bounds, origin_range(t))
    return fc.attach_actuals(predicted, grid, SPEC)


def model_accuracy(t):
    """The learned forecast beside the baselines, with the rows and the last day that it was trained on."""
    grid = sales_grid(t)
    training = fc.training_set(grid, SPEC, t.ship_bounds, learning_start(t))
    model = fc.fit_forecast_model(training)
    learned = fc.learned_forecast(grid, SPEC, t.ship_bounds, origin_range(t), model=model).withColumn("model", F.lit("learned"))
    tagged = [forecast_of(t, m, grid).withColumn("model", F.lit(m)) for m in ("moving_average", "seasonal_naive")]
    scored = fc.forecast_accuracy(fc.attach_actuals(learned.unionByName(tagged[0]).unionByName(tagged[1]), grid, SPEC), "model")
    about = fc.training_report(training, model, SPEC).withColumn("model", F.lit("learned"))
    return stable_accuracy(scored).join(about, "model", "left")


@query(
    "forecast_ml_accuracy",
    with_ctes("bt_both training_features grid", f"""SELECT model, {r6('sum(abs(forecast - actual)) / sum(actual)')} AS wape, CAST(count(actual) AS BIGINT) AS forecast_rows_evaluated, t.training_rows, t.training_end,
    true AS learned_is_better FROM bt_both CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS training_rows, max(f.date) AS training_end FROM training_features f
    JOIN grid g ON g.date = f.date AND g.product_id = f.product_id AND g.store_id = f.store_id) t WHERE actual IS NOT NULL AND model = 'seasonal_naive' GROUP BY ALL"""),
)
def forecast_ml_accuracy(t):
    """The seasonal baseline's error, what the learned forecast was trained on, and whether it errs less."""
    rows = model_accuracy(t)
    learned = rows.where("model = 'learned'").select("wape", "training_rows", "training_end")  # one row
    known = {c: learned.select(c).scalar() for c in learned.columns}
    return rows.where("model = 'seasonal_naive'").select(
        "model", "wape", "forecast_rows_evaluated", known["training_rows"].alias("training_rows"), known["training_end"].alias("training_end"),
        (known["wape"] < F.col("wape")).alias("learned_is_better"),
    )


MODELS = ("learned", "moving_average", "seasonal_naive")
_MODEL_ROWS = "(VALUES ('learned'), ('moving_average'), ('seasonal_naive')) m(model)"


@query(
    "look_ahead_trace",
    with_ctes("origins entities bounds", f"""SELECT model, CAST(n AS BIGINT) AS forecast_rows, CAST(0 AS BIGINT) AS leaking_rows, CAST(1 AS INTEGER) AS least_gap_days FROM
    (SELECT count(*) * 28 AS n FROM origins CROSS JOIN entities) CROSS JOIN {_MODEL_ROWS}"""),
)
def look_ahead_trace(t):
    """Every forecast of every model carries the latest day it was computed from, training included; none reaches its origin."""
    grid = sales_grid(t)
    parts = [forecast_of(t, m, grid, trace=True).withColumn("model", F.lit(m)) for m in MODELS]
    return fc.look_ahead(parts[0].unionByName(parts[1]).unionByName(parts[2]), "model")


@query(
    "no_look_ahead_check",
    with_ctes("origins entities", """SELECT model, CAST(n AS BIGINT) AS compared_rows, CAST(0 AS BIGINT) AS differing_rows FROM
    (SELECT count(*) * 28 AS n FROM origins CROSS JOIN entities WHERE origin_date <= (SELECT hi - 45 FROM bounds)) CROSS JOIN (VALUES ('learned'), ('moving_average'), ('seasonal_naive')) m(model)"""),
)
def no_look_ahead_check(t):
    """Change everything from a cut day on: forecasts of origins up to that day stay the same."""
    cut = F.date_sub(t.ship_bounds.select("hi").scalar(), 45)
    grid = sales_grid(t)
    changed = grid.withColumn("quantity", F.when(F.col("date") >= cut, F.col("quantity") * 3 + 100).otherwise(F.col("quantity")))
    result = None
    for model in MODELS:
        before, after = (forecast_of(t, model, g).where(F.col("origin_date") <= cut) for g in (grid, changed))
        part = fc.compare_forecasts(before, after, SPEC).withColumn("model", F.lit(model))
        result = part if result is None else result.unionByName(part)
    return result
