"""Reproducible draws keyed by (seed, column, row key).

A draw depends only on its key, so results are the same for any partitioning, retry or task order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockweave.functions.numeric import round_half_even

TWO_POW_48 = float(2**48)


def table_seed(seed: int, table: str) -> int:
    """One independent seed per table: the first 32 bits of SHA-256 over ``seed:table``."""
    return int(hashlib.sha256(f"{seed}:{table}".encode()).hexdigest()[:8], 16)


def hash48(text: Column) -> Column:
    """The first 48 bits of MD5 as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def seeded_uniform(seed: int, column: str, *key: Column) -> Column:
    """U[0, 1) from the row key."""
    parts = [F.lit(str(seed)), F.lit(column), *[k.cast("string") for k in key]]
    return hash48(F.concat_ws(":", *parts)).cast("double") / F.lit(TWO_POW_48)


def seeded_normal(seed: int, column: str, *key: Column) -> Column:
    """N(0, 1) by the Box-Muller transform of two keyed uniforms."""
    u1 = seeded_uniform(seed, f"{column}.u1", *key)
    u2 = seeded_uniform(seed, f"{column}.u2", *key)
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1))
    return radius * F.cos(F.lit(2.0 * math.pi) * u2)


def cumulative_weights(count: int, weights: Sequence[float] | None) -> list[float]:
    if count < 1:
        raise ValueError("at least one value is required")
    if weights is None:
        weights = [1.0] * count
    if len(weights) != count or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must be non-negative, one per value, and not all zero")
    total, running, bounds = float(sum(weights)), 0.0, []
    for w in weights:
        running += w
        bounds.append(running / total)
    return bounds


def weighted_choice(uniform: Column, values: Sequence[object], weights: Sequence[float] | None = None) -> Column:
    """Pick from ``values`` by comparing a uniform with cumulative weights."""
    bounds = cumulative_weights(len(values), weights)
    last = max(i for i in range(len(values)) if i == 0 or bounds[i] > bounds[i - 1])
    picked = None
    for bound, value in zip(bounds[:last], values[:last]):
        condition = uniform < F.lit(bound)
        picked = F.when(condition, F.lit(value)) if picked is None else picked.when(condition, F.lit(value))
    return F.lit(values[last]) if picked is None else picked.otherwise(F.lit(values[last]))


def uniform_between(uniform: Column, low: float, high: float, decimals: int | None = None) -> Column:
    if low > high:
        raise ValueError("low must be <= high")
    value = F.lit(float(low)) + uniform * F.lit(float(high) - float(low))
    return value if decimals is None else round_half_even(value, decimals)


def uniform_integer(uniform: Column, low: int, high: int) -> Column:
    """Inclusive integer range."""
    if low > high:
        raise ValueError("low must be <= high")
    return (F.floor(uniform * F.lit(float(high - low + 1))) + F.lit(low)).cast("bigint")
