"""Rounding, ratios and normal quantiles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal quantile (P. J. Acklam, public).
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
              1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
              6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
              -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
              3.754408661907416e00)
QUANTILE_TAIL = 0.02425


def as_column(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def round_half_even(value: Column, decimals: int = 0) -> Column:
    """Round to ``decimals`` places, halves to the even neighbour."""
    if decimals == 0:
        return F.rint(value.cast("double"))
    scale = float(10**decimals)
    return F.rint(value.cast("double") * scale) / F.lit(scale)


def round_half_even_int(value: Column) -> Column:
    return F.rint(value.cast("double")).cast("bigint")


def stable6(value: Column) -> Column:
    """Six decimals, halves up; identical in every engine with IEEE doubles."""
    return F.floor(value * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    """Null instead of a substitute number when the denominator is not positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))


def clip(value: Column, low: object | None = None, high: object | None = None) -> Column:
    """Bound a column; nulls stay null."""
    bounded = value
    if low is not None:
        bounded = F.when(bounded < as_column(low), as_column(low)).otherwise(bounded)
    if high is not None:
        bounded = F.when(bounded > as_column(high), as_column(high)).otherwise(bounded)
    return bounded


def ceil_to_multiple(value: Column, multiple: Column) -> Column:
    """Smallest multiple of ``multiple`` that is not below ``value``."""
    return (F.ceil(value.cast("double") / multiple.cast("double")) * multiple).cast("bigint")


def _horner(coefficients: tuple[float, ...], x: Column, tail: float | None = None) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total if tail is None else total * x + F.lit(tail)


def normal_quantile(p: Column) -> Column:
    """Inverse standard normal CDF for 0 < p < 1 (relative error below 1.2e-9)."""
    centre = p - F.lit(0.5)
    square = centre * centre
    central = _horner(QUANTILE_A, square) * centre / _horner(QUANTILE_B, square, 1.0)
    low = F.sqrt(F.lit(-2.0) * F.ln(p))
    lower = _horner(QUANTILE_C, low) / _horner(QUANTILE_D, low, 1.0)
    high = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    upper = -_horner(QUANTILE_C, high) / _horner(QUANTILE_D, high, 1.0)
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < QUANTILE_TAIL, lower)
        .when(p > 1 - QUANTILE_TAIL, upper)
        .otherwise(central)
    )
