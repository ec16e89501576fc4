"""Boosted trees against a plain numpy version, and look-ahead traces with planted leaks."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.plans import boosting as B
from stockweave.plans import forecast as fc
from stockweave.queries.forecasting import model_accuracy
from stockweave.sources.drivertables import DriverTables

SF = "/root/testdata/sf0.001"


def plain(x, y, offset, edges, trees, depth, rate, smoothing, least):
    """Raw scores of the same trees, grown in memory."""
    bins = np.array([[sum(v > e for e in edges[j]) for j, v in enumerate(row)] for row in x])
    base = math.log(y.sum() / np.exp(offset).sum())
    score = offset + base
    for _ in range(trees):
        g, h, step = y - np.exp(score), np.exp(score), np.zeros(len(y))

        def grow(rows, left):
            best = None
            if left:
                for j in range(x.shape[1]):
                    for cut in range(len(edges[j])):
                        low = rows[bins[rows, j] <= cut]
                        high = rows[bins[rows, j] > cut]
                        if len(high) and min(h[low].sum(), h[high].sum()) >= least:
                            gain = g[low].sum() ** 2 / (h[low].sum() + smoothing) + g[high].sum() ** 2 / (h[high].sum() + smoothing) - g[rows].sum() ** 2 / (h[rows].sum() + smoothing)
                            gain = float(f"{gain:.6g}")
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, low, high)
            if best is None:
                step[rows] = rate * g[rows].sum() / (h[rows].sum() + smoothing)
                return
            grow(best[1], left - 1)
            grow(best[2], left - 1)

        grow(np.arange(len(y)), depth)
        score = score + step
    return score


def test_trees_equal_a_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=600), rng.integers(0, 5, 600), np.full(600, 3.0), rng.exponential(size=600)])
    y = rng.poisson(np.exp(0.5 * (x[:, 0] > 0.3) + 0.2 * x[:, 1])).astype(float)
    level = rng.uniform(0.5, 2, 600)
    rows = [(*map(float, r), float(t), float(v)) for r, t, v in zip(x, y, level)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, level double")
    cuts = {c: sorted(set(np.quantile(x[:, j], np.linspace(0, 1, 17)[:-1], method="lower").tolist())) for j, c in enumerate("abcd")}
    monkeypatch.setattr(B, "quantile_edges", lambda rows, features: cuts)  # approximate quantiles depend on the partitions
    for parts in (1, 5):
        shuffled = df.repartition(parts)
        model = B.fit_poisson(shuffled, ["a", "b", "c", "d"], "y", offset="level", trees=4, depth=3, least=5.0)
        edges = list(cuts.values())
        got = {tuple(r[:4]): r["s"] for r in df.withColumn("s", model.score()).collect()}
        want = plain(x, y, np.log(level), edges, 4, 3, 0.5, 1.0, 5.0)
        assert np.allclose([got[tuple(map(float, r))] for r in x], want, atol=1e-6)
        assert set(model.gains()) <= {"a", "b", "d"} and model.rows == 600


def test_cut_points_are_near_the_quantiles(spark):
    df = spark.range(10_000).select((F.col("id") * 1.0).alias("a"), F.lit(None).cast("double").alias("b"), (F.col("id") % 3).cast("double").alias("c"))
    edges = B.quantile_edges(df, ["a", "b", "c"])
    assert len(edges["a"]) == B.BINS and max(abs(e - 10_000 * k / B.BINS) for k, e in enumerate(edges["a"])) <= 40
    assert edges["b"] == [] and edges["c"] == [0.0, 1.0, 2.0]


def test_missing_values_constants_and_empty_tables(spark):
    shape = "a double, y double"
    rows = [(None, 9.0)] * 200 + [(float(k % 7), 1.0) for k in range(200)]
    model = B.fit_poisson(spark.createDataFrame(rows, shape), ["a"], "y", trees=30, depth=2)
    rate = {r["a"]: r["m"] for r in spark.createDataFrame(rows, shape).withColumn("m", model.rate()).groupBy("a").agg(F.avg("m").alias("m")).collect()}
    assert rate[None] < rate[0.0] + 8 and rate[6.0] == pytest.approx(1.0, abs=0.2)
    flat = B.fit_poisson(spark.createDataFrame([(1.0, 4.0)] * 50, shape), ["a"], "y")
    assert flat.trees == () and spark.range(1).select(flat.rate()).first()[0] == pytest.approx(4.0)
    none = B.fit_poisson(spark.createDataFrame([], shape), ["a"], "y")
    assert none.rows == 0 and spark.range(1).select(none.rate()).first()[0] == pytest.approx(B.LOWEST_RATE)


def test_learned_forecast_beats_the_seasonal_naive_one(spark):
    rows = {r["model"]: r for r in model_accuracy(DriverTables(spark, "/root/testdata/sf0.01")).collect()}
    assert rows["learned"]["wape"] < 0.95 * rows["seasonal_naive"]["wape"] and abs(rows["learned"]["bias"]) < 0.05
    assert rows["learned"]["training_rows"] == 84840 and rows["learned"]["trees"] >= 1 and rows["learned"]["top_feature"]
    assert rows["seasonal_naive"]["training_rows"] is None


SPEC = fc.ForecastSpec(("item",))
FIRST, START, LAST = dt.date(2015, 1, 1), dt.date(2015, 10, 5), dt.date(2015, 12, 1)


@pytest.fixture
def grid(spark):
    days = spark.createDataFrame([(FIRST, LAST)], "lo date, hi date").select(F.explode(F.sequence("lo", "hi")).alias("date"))
    return days.select("date", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("item")).withColumn("quantity", F.dayofmonth("date") + F.length("item"))


def forecasts(spark, grid, model, **options):
    bounds = spark.createDataFrame([(FIRST, LAST)], "lo date, hi date")
    origins = fc.OriginRange(START, LAST, FIRST, LAST)
    make = {"moving": lambda: fc.moving_average_forecast(grid, SPEC, origins, trace=True), "naive": lambda: fc.seasonal_naive_forecast(grid, SPEC, origins, trace=True),
            "learned": lambda: fc.learned_forecast(grid, SPEC, bounds, origins, window_days=150, trace=True, **options)}
    return make[model]()


@pytest.mark.parametrize("model", ["moving", "naive", "learned"])
def test_traces_reach_the_day_before_the_origin_only(spark, grid, model):
    made = forecasts(spark, grid, model)
    row = fc.look_ahead(made).first()
    assert (row["forecast_rows"], row["leaking_rows"], row["least_gap_days"]) == (9 * 28 * 2, 0, 1)
    assert made.where("datediff(origin_date, seen_through) <> 1").count() == 0


@pytest.mark.parametrize("model", ["moving", "naive", "learned"])
def test_a_planted_leak_is_found(spark, grid, model):
    """A table smoothed over the days around each day carries those days: every model that reads it looks ahead."""
    from pyspark.sql import Window as W

    around = W.partitionBy("item").orderBy("date").rowsBetween(-3, 3)
    smooth = grid.withColumns({"quantity": F.avg("quantity").over(around), "seen_through": F.max("date").over(around)})
    row = fc.look_ahead(forecasts(spark, smooth, model)).first()
    assert row["leaking_rows"] == row["forecast_rows"] and row["least_gap_days"] == -2


def test_training_beyond_the_first_origin_is_found(spark, grid):
    """Features without fault do not excuse a model that saw later targets."""
    late = grid.withColumn("seen_through", F.when((F.col("item") == "B") & (F.col("date") == F.lit(START - dt.timedelta(days=5))), F.lit(LAST)).otherwise(F.col("date")))
    made = forecasts(spark, late, "learned")
    found = {r["item"]: r["leaking_rows"] for r in fc.look_ahead(made, "item").collect()}
    assert found["A"] == 8 * 28 + 28 and found["B"] == 9 * 28
