"""Count and gamma samplers as vectorised Pandas functions.

Each value depends only on its row: the uniform or the 48-bit key comes in as a column, so results do
not change with partitioning or retries. Counts use the inverse CDF, which keeps draws of different
scenarios comparable (a larger rate never gives a smaller count for the same uniform).
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL_MEAN = 256.0
LARGE_SHAPE = 50.0
BLOCK = 64
ROWS = 4096


def _log_gamma(z: np.ndarray) -> np.ndarray:
    """ln Gamma(z) for z > 0: shift above 8, then the Stirling series."""
    z = np.asarray(z, dtype="float64")
    shift = np.zeros_like(z)
    x = z.copy()
    for _ in range(8):
        low = x < 8.0
        if not low.any():
            break
        shift = np.where(low, shift - np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1.0, x)
    inverse = 1.0 / x
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188))))
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series


def _gamma_share(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma for shapes below ``LARGE_SHAPE``: power series left, continued fraction right."""
    out = np.zeros(len(x))
    front = np.exp(shape * np.log(x) - x - _log_gamma(shape))
    left = x < shape + 1.0
    a, z = shape[left], x[left]
    term = 1.0 / a
    total, n = term.copy(), 0
    while len(a) and (term > total * 1e-15).any():
        n += 1
        term = term * z / (a + n)
        total += term
    out[left] = front[left] * total
    a, z = shape[~left], x[~left]
    # Lentz's scheme for the upper tail.
    b = z + 1.0 - a
    c, d = np.full(len(a), 1e300), 1.0 / b
    h, n = d.copy(), 0
    while len(a):
        n += 1
        factor = -n * (n - a)
        b = b + 2.0
        d = 1.0 / (factor * d + b)
        c = b + factor / c
        h *= d * c
        if (np.abs(d * c - 1.0) < 1e-14).all() or n > 2000:
            break
    out[~left] = 1.0 - front[~left] * h
    return out


def _gamma_quantile(u: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Standard gamma quantile for shapes below ``LARGE_SHAPE``, by bisection on the logarithm."""
    low, high = np.full(len(u), -690.0), np.full(len(u), np.log(LARGE_SHAPE * 20.0))
    for _ in range(50):
        middle = (low + high) / 2.0
        below = _gamma_share(shape, np.exp(middle)) <= u
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return np.exp((low + high) / 2.0)


def _normal_quantile(u: np.ndarray) -> np.ndarray:
    return np.array([NormalDist().inv_cdf(min(max(v, 1e-300), 1.0 - 1e-16)) for v in u.tolist()])


def _small_counts(u: np.ndarray, m: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Quantiles for means up to ``SMALL_MEAN``: blocks of probabilities, each from its own logarithm, summed upwards."""
    result, before, base = np.zeros(len(u), "int64"), np.zeros(len(u)), 0
    live = np.arange(len(u))
    poisson = np.isinf(k)
    kk = np.where(poisson, 1.0, k)
    while live.size:
        x = base + np.arange(BLOCK, dtype="float64")[None, :]
        mm, pp, ks = m[live, None], poisson[live, None], kk[live, None]
        common = x * np.log(mm) - _log_gamma(x + 1.0)
        plain = common - mm
        spread = common + _log_gamma(x + ks) - _log_gamma(ks) - ks * np.log1p(mm / ks) - x * np.log(ks + mm)
        p = np.exp(np.where(pp, plain, spread))
        cdf = before[live, None] + np.cumsum(p, axis=1)
        over = cdf > u[live, None]
        # Beyond the mean, a probability lost in the sum's rounding ends the search: no larger count can be told apart.
        ended = ~over.any(axis=1) & (p[:, -1] < 1e-17) & (base + BLOCK > m[live])
        hit = over.any(axis=1)
        result[live[hit]] = base + over[hit].argmax(axis=1)
        result[live[ended]] = base + (p[ended] >= 1e-17).sum(axis=1)
        before[live] = cdf[:, -1]
        live = live[~(hit | ended)]
        base += BLOCK
    return result


def _large_counts(u: np.ndarray, m: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Quantiles of the shifted gamma law with the count's mean, variance and skewness; time does not depend on the mean.

    Which of the two quantile formulas is used depends on the dispersion only, so counts still grow with the rate.
    """
    ratio = np.where(np.isinf(k), 0.0, m / k)
    shape = 4.0 * m * (1.0 + ratio) / (1.0 + 2.0 * ratio) ** 2
    scale = (1.0 + 2.0 * ratio) / 2.0
    shift = m - shape * scale
    exact = k < LARGE_SHAPE
    q = np.empty(len(u))
    if exact.any():
        q[exact] = _gamma_quantile(u[exact], np.minimum(shape[exact], LARGE_SHAPE))
    if not exact.all():
        s = shape[~exact]
        q[~exact] = s * np.maximum(1.0 - 1.0 / (9.0 * s) + _normal_quantile(u[~exact]) / (3.0 * np.sqrt(s)), 0.0) ** 3
    return np.maximum(np.floor(shift + scale * q + 0.5), 0.0).astype("int64")


def inverse_count_cdf(uniform: np.ndarray, mean: np.ndarray, dispersion: np.ndarray) -> np.ndarray:
    """Smallest count whose CDF exceeds the uniform; infinite dispersion gives the Poisson law.

    Means up to ``SMALL_MEAN`` are summed exactly; larger ones use a closed approximation (within a few hundredths of
    a standard deviation) that never falls below the exact count at ``SMALL_MEAN``, so draws stay monotone in the rate.
    """
    uniform, mean, k = (np.asarray(v, dtype="float64") for v in (uniform, mean, dispersion))
    if not np.isfinite(mean).all() or not ((uniform >= 0) & (uniform < 1)).all() or not (k > 0).all():
        raise ValueError("counts need finite means, uniforms in [0, 1) and positive dispersions")
    result = np.zeros(len(mean), dtype="int64")
    live = np.flatnonzero(mean > 0)
    for at in range(0, len(live), ROWS):
        rows = live[at : at + ROWS]
        result[rows] = _small_counts(uniform[rows], np.minimum(mean[rows], SMALL_MEAN), k[rows])
    large = np.flatnonzero(mean > SMALL_MEAN)
    result[large] = np.maximum(result[large], _large_counts(uniform[large], mean[large], k[large]))
    return result


def _mixed(state: np.ndarray) -> np.ndarray:
    """SplitMix64 output function (public algorithm)."""
    with np.errstate(over="ignore"):
        z = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def key_uniform(key: np.ndarray, counter: int) -> np.ndarray:
    """The ``counter``-th uniform in (0, 1) of each key."""
    with np.errstate(over="ignore"):
        state = key.astype("uint64") + np.uint64((counter + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return ((_mixed(_mixed(state)) >> np.uint64(11)).astype("float64") + 0.5) / float(2**53)


def gamma_values(key: np.ndarray, shape: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Gamma draws by the Marsaglia-Tsang method with counter-based uniforms per row."""
    key, shape, scale = np.asarray(key), np.asarray(shape, dtype="float64"), np.asarray(scale, dtype="float64")
    boosted = np.where(shape < 1.0, shape + 1.0, shape)
    d = boosted - 1.0 / 3.0
    c = 1.0 / np.sqrt(9.0 * d)
    out = np.zeros(len(key))
    open_rows = np.arange(len(key))
    attempt = 0
    while open_rows.size:
        u1, u2, u3 = (key_uniform(key[open_rows], 3 * attempt + i + 1) for i in range(3))
        z = np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)
        v = (1.0 + c[open_rows] * z) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            accepted = (v > 0) & (np.log(u3) < 0.5 * z * z + d[open_rows] - d[open_rows] * v + d[open_rows] * np.log(v))
        done = open_rows[accepted]
        out[done] = d[done] * v[accepted]
        open_rows = open_rows[~accepted]
        attempt += 1
    boost = np.where(shape < 1.0, key_uniform(key, 0) ** (1.0 / shape), 1.0)
    return out * boost * scale


def negative_binomial(uniform: Column, mean: Column, dispersion: Column) -> Column:
    """Counts with the given mean and variance mean + mean^2 / dispersion."""

    @F.pandas_udf("bigint")
    def draw(u: pd.Series, m: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(inverse_count_cdf(u.to_numpy(), m.to_numpy(), k.to_numpy()))

    return draw(uniform, mean, dispersion)


def poisson(uniform: Column, mean: Column) -> Column:
    return negative_binomial(uniform, mean, F.lit(float("inf")))


def gamma(key: Column, shape: Column, scale: Column) -> Column:
    @F.pandas_udf("double")
    def draw(k: pd.Series, a: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(gamma_values(k.to_numpy(), a.to_numpy(), s.to_numpy()))

    return draw(key, shape, scale)
