"""Rolling-origin forecasts without look-ahead.

History reaches a forecast by scattering each grid row to the origins whose window covers it (pure
date arithmetic, no range join) and aggregating per (entity, origin). A row feeds at most
``window / interval`` origins, so work is linear in the grid and partial sums run before the shuffle.
Every history window is anchored at ``min(origin - 1, last grid day)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockweave.functions.calendar import season_position
from stockweave.functions.numeric import as_column, ratio_or_null
from stockweave.operators.windows import same_weekday_mean, trailing_means
from stockweave.plans.boosting import BoostedModel, fit_poisson


@dataclass(frozen=True)
class ForecastSpec:
    entities: tuple[str, ...]
    time: str = "date"
    value: str = "quantity"
    interval_days: int = 7
    horizon_days: int = 28


@dataclass(frozen=True)
class OriginRange:
    """Origins ``start, start + interval, ... <= end``; grid bounds as dates or scalar columns."""

    start: object
    end: object
    grid_lo: object
    grid_hi: object

    def columns(self) -> tuple[Column, Column, Column, Column]:
        return tuple(as_column(v).cast("date") for v in (self.start, self.end, self.grid_lo, self.grid_hi))


def scatter_to_origins(grid: DataFrame, spec: ForecastSpec, origins: OriginRange, window_days: int) -> DataFrame:
    """Grid rows repeated once per origin whose last ``window_days`` days contain them.

    Adds ``origin_date`` and ``age`` (0 for the newest day of the window).
    """
    start, end, lo, hi = origins.columns()
    day = F.col(spec.time)
    no_history = F.raise_error(F.lit("no observations before the first forecast origin")).cast("boolean")
    grid = grid.where(F.when(start <= lo, no_history).otherwise(F.lit(True)))
    # Rows of the last window serve every later origin, because history stops growing there.
    last = F.when(day > F.date_sub(hi, window_days), end).otherwise(F.least(F.date_add(day, window_days), end))
    first_index = F.greatest(F.ceil(F.datediff(F.date_add(day, 1), start) / F.lit(spec.interval_days)), F.lit(0).cast("bigint"))
    last_index = F.floor(F.datediff(last, start) / F.lit(spec.interval_days))
    needed = grid.where((day > F.date_sub(F.least(F.date_sub(start, 1), hi), window_days)) & (day < end)).where(last_index >= first_index)
    exploded = needed.select("*", F.explode(F.sequence(first_index, last_index)).alias("_k"))
    origin = F.date_add(start, (F.col("_k") * spec.interval_days).cast("int"))
    with_origin = exploded.withColumn("origin_date", origin)
    anchor = F.least(F.date_sub(F.col("origin_date"), 1), hi)
    return with_origin.withColumn("age", F.datediff(anchor, day).cast("int")).drop("_k")


def expand_horizon(df: DataFrame, spec: ForecastSpec) -> DataFrame:
    """One row per horizon day: ``horizon_day`` (0-based) and the target date."""
    days = F.sequence(F.lit(0), F.lit(spec.horizon_days - 1))
    expanded = df.select("*", F.explode(days).alias("horizon_day"))
    return expanded.withColumn(spec.time, F.date_add("origin_date", F.col("horizon_day")))


#: The latest day whose observation a forecast or feature was computed from; kept beside it through every window and join on request.
SEEN = "seen_through"


def _seen(spec: ForecastSpec, trace: bool) -> list[Column]:
    """The same rows that an aggregate reads also say how late they are; a table that has ``seen_through`` brings its own days."""
    return [F.max(SEEN).alias(SEEN)] if trace else []


def traced(grid: DataFrame, spec: ForecastSpec) -> DataFrame:
    """``grid`` whose values are known to come from their own day, unless it says otherwise."""
    return grid if SEEN in grid.columns else grid.withColumn(SEEN, F.col(spec.time))


def moving_average_forecast(grid: DataFrame, spec: ForecastSpec, origins: OriginRange, window_days: int = 28, trace: bool = False) -> DataFrame:
    """Flat forecast: mean of the last ``window_days`` grid days before each origin."""
    scattered = scatter_to_origins(traced(grid, spec) if trace else grid, spec, origins, window_days)
    levels = scattered.groupBy("origin_date", *spec.entities).agg(F.avg(spec.value).alias("forecast"), *_seen(spec, trace))
    return expand_horizon(levels, spec).select("origin_date", spec.time, *spec.entities, "forecast", *[SEEN] * trace)


def seasonal_naive_forecast(
    grid: DataFrame, spec: ForecastSpec, origins: OriginRange, season_days: int = 7, seasons: int = 4, trace: bool = False
) -> DataFrame:
    """Mean of the last ``seasons`` values at the target's season position; 0 without any.

    One average per season position is kept per (entity, origin); the horizon only looks them up.
    """
    scattered = scatter_to_origins(traced(grid, spec) if trace else grid, spec, origins, season_days * seasons)
    position = F.col("age") % season_days
    averages = [F.avg(F.when(position == p, F.col(spec.value))) for p in range(season_days)]
    profile = scattered.groupBy("origin_date", *spec.entities).agg(F.array(*averages).alias("_means"), *_seen(spec, trace))
    _, _, _, hi = origins.columns()
    expanded = expand_horizon(profile, spec)
    anchor = F.least(F.date_sub(F.col("origin_date"), 1), hi)
    gap = F.datediff(F.col(spec.time), anchor)
    value = F.coalesce(F.get(F.col("_means"), season_position(gap, season_days)), F.lit(0.0))
    return expanded.select("origin_date", spec.time, *spec.entities, value.alias("forecast"), *[SEEN] * trace)


def attach_actuals(forecast: DataFrame, grid: DataFrame, spec: ForecastSpec) -> DataFrame:
    """Left join of observed values; null beyond the data. Forecasts are clipped at 0.

    Other columns of the forecast (such as a model name) are kept, so several models can be unioned
    first and meet the observations in one join.
    """
    keys = [spec.time, *spec.entities]
    actual = grid.select(*keys, F.col(spec.value).cast("double").alias("actual"))
    clipped = forecast.withColumn("forecast", F.greatest(F.col("forecast").cast("double"), F.lit(0.0)))
    tags = [c for c in forecast.columns if c not in ("origin_date", *keys, "forecast")]
    return clipped.join(actual, keys, "left").select("origin_date", *keys, *tags, "forecast", "actual")


def accuracy_columns() -> list[Column]:
    """Rows evaluated, MAE, RMSE, WAPE and bias over rows with an actual."""
    has = F.col("actual").isNotNull()
    error = F.when(has, F.col("forecast") - F.col("actual"))
    total = F.sum(F.when(has, F.col("actual")))
    return [
        F.count("actual").alias("forecast_rows_evaluated"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        ratio_or_null(F.sum(F.abs(error)), total).alias("wape"),
        ratio_or_null(F.sum(error), total).alias("bias"),
    ]


def forecast_accuracy(forecasts: DataFrame, *by: str) -> DataFrame:
    return forecasts.groupBy(*by).agg(*accuracy_columns()) if by else forecasts.agg(*accuracy_columns())


def trailing_frame(spec: ForecastSpec) -> W:
    return W.partitionBy(*spec.entities).orderBy(spec.time)


# --- features, training set and a learned model --------------------------------------------------

# Feature names of the learned forecast and the shortest history it accepts.
FEATURES = ("horizon_day", "weekday", "month", "last_value", "mean_7", "mean_28", "mean_365", "mean_same_weekday_4")
MIN_HISTORY_DAYS = 28


def day_features(grid: DataFrame, spec: ForecastSpec, trace: bool = False) -> DataFrame:
    """What is known at the end of each grid day: last value, trailing means, weekday means.

    ``_weekday_means[j]`` belongs to the weekday j days back. One shuffle by entity serves the running
    sums and the lags; the weekday means need one more.
    """
    weekday = same_weekday_mean(traced(grid, spec) if trace else grid, spec.entities, 4, spec.time, spec.value)
    means = trailing_means(weekday, spec.entities, (7, 28, 365), spec.time, spec.value, inclusive=True)
    lags = [F.lag("mean_same_weekday_4", j).over(trailing_frame(spec)) for j in range(7)]
    # every feature's frame ends at the current row, so the latest day in the widest frame bounds them all
    seen = [F.max(SEEN).over(trailing_frame(spec).rowsBetween(W.unboundedPreceding, 0)).alias(SEEN)] if trace else []
    return means.select(
        spec.time, *spec.entities, F.col(spec.value).cast("double").alias("last_value"), "mean_7", "mean_28", "mean_365", F.array(*lags).alias("_weekday_means"), *seen
    )


def forecast_features(grid: DataFrame, spec: ForecastSpec, origins: DataFrame, grid_hi: object, trace: bool = False) -> DataFrame:
    """Features per (origin, horizon day, entity), from observations before the origin only."""
    hi = as_column(grid_hi).cast("date")
    anchored = origins.select("origin_date", F.least(F.date_sub("origin_date", 1), hi).alias(spec.time))
    known = day_features(grid, spec, trace).join(anchored, spec.time).withColumnRenamed(spec.time, "_anchor")
    expanded = expand_horizon(known, spec)
    back = F.pmod(F.weekday("_anchor") - F.weekday(spec.time), F.lit(7))
    same = F.coalesce(F.get("_weekday_means", back), F.col("mean_28"))
    return expanded.select(
        "origin_date", spec.time, *spec.entities, F.col("horizon_day").cast("bigint").alias("horizon_day"),
        F.weekday(spec.time).cast("bigint").alias("weekday"), F.month(spec.time).cast("bigint").alias("month"),
        "last_value", "mean_7", "mean_28", "mean_365", same.alias("mean_same_weekday_4"), *[SEEN] * trace,
    )


def training_origins(bounds: DataFrame, spec: ForecastSpec, start: object, window_days: int = 730, step_days: int = 7) -> DataFrame:
    """Origins backward from the last one whose targets end before ``start``; at least 28 days of history."""
    lo, first_day = F.col("lo").cast("date"), as_column(start).cast("date")
    needed = MIN_HISTORY_DAYS + spec.horizon_days
    short = F.datediff(first_day, lo) < needed
    last = F.when(short, F.raise_error(F.lit(f"the learned forecast needs at least {needed} days before its start")).cast("date")).otherwise(
        F.date_sub(first_day, spec.horizon_days)
    )
    first = F.greatest(F.date_add(lo, MIN_HISTORY_DAYS), F.date_sub(first_day, window_days))
    dates = F.when(last >= first, F.sequence(last, first, F.expr(f"interval -{int(step_days)} day"))).otherwise(F.array().cast("array<date>"))
    return bounds.select(F.explode(dates).alias("origin_date"))


def training_set(
    grid: DataFrame, spec: ForecastSpec, bounds: DataFrame, start: object, window_days: int = 730, step_days: int = 7, trace: bool = False
) -> DataFrame:
    """Features joined with their targets, all dated before ``start``; traced, ``seen_through`` covers the target too."""
    history = (traced(grid, spec) if trace else grid).where(F.col(spec.time) < as_column(start).cast("date"))
    origins = training_origins(bounds, spec, start, window_days, step_days)
    features = forecast_features(history, spec, origins, F.date_sub(as_column(start).cast("date"), 1), trace)
    target = history.select(spec.time, *spec.entities, F.col(spec.value).cast("double").alias("target"), *[F.col(SEEN).alias("_target_seen")] * trace)
    joined = features.join(target, [spec.time, *spec.entities])
    return joined.withColumn(SEEN, F.greatest(SEEN, "_target_seen")).drop("_target_seen") if trace else joined


#: What the trees see besides the calendar: levels relative to the last 28 days, which is the offset.
RATIOS = ("last_value", "mean_7", "mean_365", "mean_same_weekday_4")
LEARNED_FEATURES = ("horizon_day", "weekday", "month", "mean_28", *[f"ratio_{c}" for c in RATIOS])


def _design(features: DataFrame) -> DataFrame:
    level = F.greatest(F.col("mean_28"), F.lit(1e-3))
    return features.withColumns({f"ratio_{c}": F.col(c) / level for c in RATIOS})


def fit_forecast_model(training: DataFrame, **options) -> BoostedModel:
    """One global Poisson model of boosted trees on top of the 28-day level."""
    return fit_poisson(_design(training), LEARNED_FEATURES, "target", offset="mean_28", **options)


def learned_forecast(
    grid: DataFrame, spec: ForecastSpec, bounds: DataFrame, origins: OriginRange, window_days: int = 730, step_days: int = 7, trace: bool = False,
    model: BoostedModel | None = None,
) -> DataFrame:
    """Train before the first origin, then forecast every origin directly for the whole horizon.

    Traced, ``seen_through`` is the later of a forecast's own features and everything the model was trained on.
    """
    start, end, _, hi = origins.columns()
    rows = training_set(grid, spec, bounds, start, window_days, step_days, trace)
    fitted = model or fit_forecast_model(rows)
    dates = bounds.select(F.explode(F.sequence(start, end, F.expr(f"interval {spec.interval_days} day"))).alias("origin_date"))
    predicted = _design(forecast_features(grid, spec, dates, hi, trace)).withColumn("forecast", fitted.rate())
    if trace:
        trained = rows.agg(F.max(SEEN)).scalar()
        predicted = predicted.withColumn(SEEN, F.greatest(F.col(SEEN), trained))
    return predicted.select("origin_date", spec.time, *spec.entities, F.greatest(F.col("forecast"), F.lit(0.0)).alias("forecast"), *[SEEN] * trace)


def training_report(training: DataFrame, model: BoostedModel, spec: ForecastSpec) -> DataFrame:
    """``training_rows, training_end, trees, top_feature``: what the learned forecast was made from."""
    gains = sorted(model.gains().items(), key=lambda g: (-g[1], g[0]))
    return training.agg(
        F.count(F.lit(1)).alias("training_rows"), F.max(spec.time).alias("training_end"), F.lit(len(model.trees)).alias("trees"),
        F.lit(gains[0][0] if gains else None).cast("string").alias("top_feature"),
    )


def look_ahead(forecasts: DataFrame, *by: str) -> DataFrame:
    """Forecasts, those computed from anything of their origin day or later, and the least days between the two."""
    late = F.col(SEEN) >= F.col("origin_date")
    measures = [F.count(F.lit(1)).alias("forecast_rows"), F.count_if(late).alias("leaking_rows"), F.min(F.datediff("origin_date", SEEN)).alias("least_gap_days")]
    return forecasts.groupBy(*by).agg(*measures) if by else forecasts.agg(*measures)


def compare_forecasts(left: DataFrame, right: DataFrame, spec: ForecastSpec) -> DataFrame:
    """Rows compared and rows that differ between two forecast tables."""
    keys = ["origin_date", spec.time, *spec.entities]
    a = left.select(*keys, F.col("forecast").alias("_a"), F.lit(1).alias("_in_a"))
    b = right.select(*keys, F.col("forecast").alias("_b"), F.lit(1).alias("_in_b"))
    both = a.join(b, keys, "full_outer")
    differs = F.col("_in_a").isNull() | F.col("_in_b").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))
    return both.agg(F.count(F.lit(1)).alias("compared_rows"), F.count_if(differs).alias("differing_rows"))


def grouped_accuracy(forecasts: DataFrame, spec: ForecastSpec, model: str = "model") -> DataFrame:
    """Accuracy overall and by model, origin and series, from one pass with grouping sets."""
    first = spec.entities
    sets = [[], [F.col(model)], [F.col(model), F.col("origin_date")], [F.col(model), *[F.col(e) for e in first]]]
    return forecasts.groupingSets(sets, F.col(model), F.col("origin_date"), *[F.col(e) for e in first]).agg(*accuracy_columns())
