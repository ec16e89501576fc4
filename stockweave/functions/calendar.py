"""Date arithmetic and scenario windows as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockweave.functions.numeric import as_column


def day_index(date: Column, start: object) -> Column:
    """Days since ``start`` (0 on the start day)."""
    return F.datediff(date, as_column(start)).cast("bigint")


def plus_days(date: object, days: object) -> Column:
    return F.date_add(as_column(date), as_column(days).cast("int"))


def weekday_monday0(date: Column) -> Column:
    return F.weekday(date).cast("bigint")


def iso_weekday(date: Column) -> Column:
    return (F.weekday(date) + 1).cast("bigint")


def iso_week_id(date: Column) -> Column:
    """ISO year and week as ``yyyyww``."""
    year = F.extract(F.lit("YEAROFWEEK"), date)
    return (year * 100 + F.weekofyear(date)).cast("bigint")


def saturday_weekday_to_iso(wday: Column) -> Column:
    """Weekday numbers that start with 1 = Saturday, as ISO numbers (1 = Monday)."""
    return ((wday + 4) % 7 + 1).cast("bigint")


def has_time_part(timestamp: Column) -> Column:
    return timestamp != F.date_trunc("day", timestamp)


def shock_factor(day: Column, start: object, duration: object, multiplier: object) -> Column:
    """``multiplier`` inside ``[start, start + duration)``, else 1; duration 0 means no shock."""
    begin, length = as_column(start), as_column(duration)
    inside = (day >= begin) & (day < begin + length)
    return F.when(inside, as_column(multiplier).cast("double")).otherwise(F.lit(1.0))


def disruption_flag(day: Column, start: object, duration: object) -> Column:
    """True inside the disruption window; duration 0 means from the start day to the end."""
    begin, length = as_column(start), as_column(duration)
    return (day >= begin) & ((length == 0) | (day < begin + length))


def season_position(day_gap: Column, season: int) -> Column:
    """Steps back from the last observation to the target's place in the season."""
    return F.pmod(-day_gap, F.lit(season)).cast("int")
