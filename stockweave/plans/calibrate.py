"""Seasonal profiles per series and the demand they imply under a scenario."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions import calendar as C
from stockweave.functions.numeric import as_column, clip, round_half_even, round_half_even_int
from stockweave.operators.aggregates import active_rows
from stockweave.operators.spine import date_sequence

# Dispersion limits, and the dispersion of series without over-dispersion or sales.
DISPERSION_MIN = 0.05
DISPERSION_POISSON = 1e6
DISPERSION_DEFAULT = 10.0
PROFILE_DECIMALS = 6


def normalised_factors(means: Column, level: Column) -> Column:
    """Means relative to the level; present keys average 1, missing keys are 1; six decimals."""
    relative = F.transform(means, lambda m: m / level)
    present = F.filter(relative, lambda x: x.isNotNull())
    scale = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)
    scaled = F.transform(relative, lambda x: F.coalesce(F.when(scale > 0, x / scale).otherwise(x), F.lit(1.0)))
    return F.transform(scaled, lambda x: round_half_even(x, PROFILE_DECIMALS))


def seasonal_cells(sales: DataFrame, entities: Sequence[str], end: object, window_days: int | None = 730, time: str = "date",
                   value: str = "quantity", start: object | None = None) -> DataFrame:
    """Days, units and squared units of active history per series, weekday and month.

    A series has at most 84 cells and they hold all that calibration needs, so the history is read
    and shuffled once. ``window_days=None`` calibrates on everything from ``start``.
    """
    window_start = as_column(start).cast("date") if window_days is None else F.date_sub(as_column(end), window_days - 1)
    marked = active_rows(sales, entities, time, value, window_start)
    y = F.when(F.col("_active"), F.col(value).cast("double"))
    return marked.groupBy(*entities, F.weekday(time).alias("_weekday"), F.month(time).alias("_month")).agg(
        F.count_if("_active").alias("_n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("_s"), F.coalesce(F.sum(y * y), F.lit(0.0)).alias("_ss")
    )


def seasonal_factors(cells: DataFrame, entities: Sequence[str]) -> DataFrame:
    """``level`` (unrounded), ``weekly`` and ``monthly`` factors, and the cells; all 1 without sales."""

    def mean_where(condition: Column) -> Column:
        days = F.sum(F.when(condition, F.col("_n")))
        return F.when(days > 0, F.sum(F.when(condition, F.col("_s"))) / days)

    means = cells.groupBy(*entities).agg(
        F.coalesce(F.when(F.sum("_n") > 0, F.sum("_s") / F.sum("_n")), F.lit(0.0)).alias("level"),
        F.array(*[mean_where(F.col("_weekday") == d) for d in range(7)]).alias("_weekday_means"),
        F.array(*[mean_where(F.col("_month") == m) for m in range(1, 13)]).alias("_month_means"),
        F.collect_list(F.struct("_weekday", "_month", "_n", "_s", "_ss")).alias("_cells"),
    )
    sells = F.col("level") > 0
    return means.withColumns({
        "weekly": F.when(sells, normalised_factors(F.col("_weekday_means"), F.col("level"))).otherwise(F.array_repeat(F.lit(1.0), 7)),
        "monthly": F.when(sells, normalised_factors(F.col("_month_means"), F.col("level"))).otherwise(F.array_repeat(F.lit(1.0), 12)),
    }).drop("_weekday_means", "_month_means")


def _moments(level: Column, weekly: Column, monthly: Column, cells: Column) -> tuple[Column, Column]:
    """Sum of squared fits and excess sum((y - fit)^2 - fit) over all days, from the cells."""

    def fit(c: Column) -> Column:
        return level * F.get(weekly, c["_weekday"]) * F.get(monthly, c["_month"] - 1)

    squares = F.aggregate(cells, F.lit(0.0), lambda a, c: a + c["_n"] * fit(c) * fit(c))
    excess = F.aggregate(cells, F.lit(0.0), lambda a, c: a + c["_ss"] - F.lit(2.0) * fit(c) * c["_s"] + c["_n"] * fit(c) * fit(c) - c["_n"] * fit(c))
    return squares, excess


def calibrate_profiles(sales: DataFrame, entities: Sequence[str], end: object, window_days: int | None = 730, time: str = "date",
                       value: str = "quantity", start: object | None = None) -> DataFrame:
    """One profile per series: level, weekly[7], monthly[12], dispersion."""
    return profiles_of(seasonal_cells(sales, entities, end, window_days, time, value, start), entities)


def profiles_of(cells: DataFrame, entities: Sequence[str]) -> DataFrame:
    """The profiles that ``seasonal_cells`` give."""
    factors = seasonal_factors(cells, entities)
    squares, excess = _moments(F.col("level"), F.col("weekly"), F.col("monthly"), F.col("_cells"))
    known = factors.withColumns({"_squares": squares, "_excess": excess})
    spread = F.when(F.col("_excess") > 0, clip(F.col("_squares") / F.col("_excess"), DISPERSION_MIN, DISPERSION_POISSON)).otherwise(F.lit(DISPERSION_POISSON))
    return known.select(
        *entities,
        round_half_even(F.col("level"), PROFILE_DECIMALS).alias("level"),
        "weekly",
        "monthly",
        F.when(F.col("level") == 0, F.lit(DISPERSION_DEFAULT)).otherwise(round_half_even(spread, PROFILE_DECIMALS)).alias("dispersion"),
    )


@dataclass(frozen=True)
class Effects:
    """Demand effects of a scenario; the defaults change nothing."""

    level_multiplier: float = 1.0
    seasonality_multiplier: float = 1.0
    noise_scale: float = 1.0
    shock_multiplier: float = 1.0
    shock_start_day: int = 0
    shock_duration_days: int = 0

    def __post_init__(self) -> None:
        for f in fields(self):
            if getattr(self, f.name) < 0:
                raise ValueError(f"{f.name} must be >= 0")


EFFECT_NAMES = tuple(f.name for f in fields(Effects))


def effects_from(parameters: Mapping[str, float], mapping: Mapping[str, str] | None = None) -> tuple[Effects, list[str], list[str]]:
    """Effects of a scenario's parameters, with the applied and the unused parameter names."""
    mapping = dict(mapping or {})
    unknown = sorted(set(mapping) - set(EFFECT_NAMES))
    if unknown:
        raise ValueError(f"unknown scenario effects {unknown}")
    named = {e: mapping.get(e, e) for e in EFFECT_NAMES}
    values = {e: parameters[p] for e, p in named.items() if p in parameters}
    applied = sorted(named[e] for e in values)
    return Effects(**values), applied, sorted(set(parameters) - set(applied))


def effect_columns(effects: Effects) -> dict[str, Column]:
    return {name: F.lit(getattr(effects, name)) for name in EFFECT_NAMES}


def profile_days(profiles: DataFrame, start: object, periods: int, time: str = "date") -> DataFrame:
    """Every profile on every horizon day: each row makes its own dates, nothing is cross joined."""
    first = as_column(start).cast("date")
    days = date_sequence(first, F.date_add(first, periods - 1))
    return profiles.select("*", F.posexplode(days).alias("day_index", time)).withColumn("day_index", F.col("day_index").cast("bigint"))


def season_of(weekly: Column, monthly: Column, date: Column, strength: Column) -> Column:
    """1 + strength * (weekday factor * month factor - 1); may be negative for strong effects."""
    pattern = F.get(weekly, F.weekday(date)) * F.get(monthly, F.month(date) - 1)
    return F.lit(1.0) + strength * (pattern - F.lit(1.0))


def expected_demand(days: DataFrame, effects: Mapping[str, Column], time: str = "date", event: Column | None = None) -> DataFrame:
    """``rate`` per series and day, ``expected`` (rounded rate) and ``season_clipped``."""
    season = season_of(F.col("weekly"), F.col("monthly"), F.col(time), effects["seasonality_multiplier"])
    shock = C.shock_factor(F.col("day_index"), effects["shock_start_day"], effects["shock_duration_days"], effects["shock_multiplier"])
    rate = (
        F.col("level") * F.greatest(season, F.lit(0.0)) * (event if event is not None else F.lit(1.0)) * effects["level_multiplier"] * shock
    )
    return days.withColumns({"rate": rate, "season_clipped": season < 0}).withColumn("expected", round_half_even_int(F.col("rate")))
