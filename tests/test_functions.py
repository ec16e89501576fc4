"""Column functions against the standard library."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.functions import calendar as C
from stockweave.functions import numeric as N
from stockweave.functions import random as R
from stockweave.functions import samplers


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def results(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_rounding_is_half_even(spark):
    df = column(spark, [0.5, 1.5, 2.5, -0.5, 2.675, 0.125])
    assert results(df, N.round_half_even_int(F.col("v"))) == [0, 2, 2, 0, 3, 0]
    assert results(df, N.round_half_even(F.col("v"), 2)) == [float(x) for x in np.round([0.5, 1.5, 2.5, -0.5, 2.675, 0.125], 2)]


def test_normal_quantile(spark):
    levels = [0.001, 0.02, 0.1, 0.5, 0.8, 0.95, 0.99, 0.9999]
    got = results(column(spark, levels), N.normal_quantile(F.col("v")))
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in levels], abs=1e-7)
    assert results(column(spark, [0.0, 1.0]), N.normal_quantile(F.col("v"))) == [None, None]


def test_ratio_and_multiple(spark):
    df = spark.createDataFrame([(6.0, 4.0), (1.0, 0.0), (-1.0, -2.0)], "a double, b double")
    assert results(df, N.ratio_or_null(F.col("a"), F.col("b"))) == [1.5, None, None]
    packs = spark.createDataFrame([(13.0, 6), (12.0, 6), (0.5, 24)], "q double, p int")
    assert results(packs, N.ceil_to_multiple(F.col("q"), F.col("p"))) == [18, 12, 24]


def test_shock_and_disruption_differ_on_duration_zero(spark):
    days = column(spark, [27, 28, 41, 42], "int")
    assert results(days, C.shock_factor(F.col("v"), 28, 14, 2.5)) == [1.0, 2.5, 2.5, 1.0]
    assert results(days, C.shock_factor(F.col("v"), 28, 0, 2.5)) == [1.0] * 4
    assert results(days, C.disruption_flag(F.col("v"), 28, 14)) == [False, True, True, False]
    assert results(days, C.disruption_flag(F.col("v"), 28, 0)) == [False, True, True, True]


def test_source_weekday_numbers(spark):
    wday = column(spark, list(range(1, 8)), "int")  # 1 = Saturday
    assert results(wday, C.saturday_weekday_to_iso(F.col("v"))) == [6, 7, 1, 2, 3, 4, 5]


def test_uniforms_do_not_depend_on_partitioning(spark):
    ids = spark.range(500)
    draw = R.seeded_uniform(7, "x", F.col("id"))
    expected = {r["id"]: r["u"] for r in ids.select("id", draw.alias("u")).collect()}
    for parts in (1, 7, 64):
        got = {r["id"]: r["u"] for r in ids.repartition(parts).select("id", draw.alias("u")).collect()}
        assert got == expected
    values = np.array(list(expected.values()))
    assert 0.45 < values.mean() < 0.55 and values.min() >= 0 and values.max() < 1


def test_choice_weights(spark):
    with pytest.raises(ValueError):
        R.cumulative_weights(2, [1.0])
    with pytest.raises(ValueError):
        R.cumulative_weights(2, [0.0, 0.0])
    u = column(spark, [0.0, 0.49, 0.5, 0.79, 0.8, 0.999])
    assert results(u, R.weighted_choice(F.col("v"), ["a", "b", "c"], [5, 3, 2])) == ["a", "a", "b", "b", "c", "c"]


def test_count_sampler_is_the_inverse_cdf():
    u = np.linspace(0.001, 0.999, 999)
    counts = samplers.inverse_count_cdf(u, np.full(999, 4.0), np.full(999, np.inf))
    p, cdf, exact = np.exp(-4.0), np.exp(-4.0), []
    table = [cdf]
    for x in range(1, 60):
        p *= 4.0 / x
        cdf += p
        table.append(cdf)
    exact = np.searchsorted(np.array(table), u, side="right")
    assert (counts == exact).all()
    assert samplers.inverse_count_cdf(u, np.zeros(999), np.full(999, 2.0)).sum() == 0


def test_sampler_moments():
    rng_u = (np.arange(200_000) + 0.5) / 200_000
    for mean, k in ((4.0, 2.0), (50.0, 0.5), (300.0, 40.0), (2000.0, np.inf)):
        x = samplers.inverse_count_cdf(rng_u, np.full(200_000, mean), np.full(200_000, k))
        variance = mean + (0 if np.isinf(k) else mean**2 / k)
        assert x.mean() == pytest.approx(mean, rel=0.01)
        assert x.var() == pytest.approx(variance, rel=0.03)
    g = samplers.gamma_values(np.arange(200_000), np.full(200_000, 9.0), np.full(200_000, 0.5))
    assert g.mean() == pytest.approx(4.5, rel=0.01) and g.var() == pytest.approx(2.25, rel=0.03)
    small = samplers.gamma_values(np.arange(200_000), np.full(200_000, 0.4), np.full(200_000, 2.0))
    assert small.mean() == pytest.approx(0.8, rel=0.02)


def test_larger_rate_never_gives_fewer_units():
    u = np.random.default_rng(1).random(5000)
    low = samplers.inverse_count_cdf(u, np.full(5000, 10.0), np.full(5000, 3.0))
    high = samplers.inverse_count_cdf(u, np.full(5000, 13.0), np.full(5000, 3.0))
    assert (high >= low).all()


def test_counts_of_any_size_follow_their_law():
    u = np.array([0.05, 0.25, 0.5, 0.75, 0.95])
    rng = np.random.default_rng(3)
    for mean in (50.0, 3_000.0, 50_000.0, 1e7):
        for k in (0.05, 3.0, 49.0, 140.0, 1e6, np.inf):
            drawn = rng.poisson(mean if np.isinf(k) else rng.gamma(k, mean / k, 200_000), 200_000)
            got = samplers.inverse_count_cdf(u, np.full(5, mean), np.full(5, k))
            spread = np.sqrt(mean + (0.0 if np.isinf(k) else mean * mean / k))
            assert np.abs(got - np.quantile(drawn, u, method="inverted_cdf")).max() <= max(1, 0.1 * spread), (mean, k)


def test_counts_grow_with_the_rate_across_both_methods():
    means = np.concatenate([np.linspace(200, 300, 200), np.geomspace(300, 1e7, 300)])
    for k in (0.05, 7.0, 49.9, 50.1, 1e5, np.inf):
        for u in (0.0, 0.01, 0.5, 0.999999):
            assert (np.diff(samplers.inverse_count_cdf(np.full(500, u), means, np.full(500, k))) >= 0).all()


def test_counts_refuse_senseless_input():
    for u, m, k in ((0.5, np.nan, 1.0), (0.5, np.inf, 1.0), (1.0, 2.0, 1.0), (np.nan, 2.0, 1.0), (0.5, 2.0, 0.0)):
        with pytest.raises(ValueError):
            samplers.inverse_count_cdf([u], [m], [k])
