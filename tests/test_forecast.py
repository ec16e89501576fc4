"""Rolling-origin forecasts on a series whose answers are known."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stockweave.operators import spine
from stockweave.operators.windows import trailing_means
from stockweave.plans import forecast as fc

WEEK = (3, 3, 3, 4, 5, 8, 9)
LAST = dt.date(2016, 2, 14)
DAYS = [LAST - dt.timedelta(days=899 - i) for i in range(900)]
SPEC = fc.ForecastSpec(("item", "site"))
START, END = dt.date(2016, 1, 4), dt.date(2016, 2, 8)


@pytest.fixture(scope="module")
def series(spark):
    rows = [(d, i, "s", WEEK[d.weekday()] * k) for d in DAYS for i, k in (("A", 1), ("B", 4))]
    return spark.createDataFrame(rows, "date date, item string, site string, quantity bigint").cache()


def origins(start=START, end=END, lo=DAYS[0], hi=LAST):
    return fc.OriginRange(start, end, lo, hi)


def test_grid_fills_and_reports_gaps(spark, series):
    holes = series.where("NOT (item = 'A' AND date IN ('2015-03-02', '2015-03-03', '2015-03-04'))")
    grid = spine.observed_grid(holes, "date", ["item", "site"], "quantity")
    assert grid.count() == 1800
    assert grid.where("NOT observed").count() == 3
    assert grid.where("NOT observed").agg(F.sum("quantity")).first()[0] == 0


def test_seasonal_naive_is_exact(series):
    forecast = fc.attach_actuals(fc.seasonal_naive_forecast(series, SPEC, origins()), series, SPEC)
    assert forecast.count() == 6 * 28 * 2
    accuracy = fc.forecast_accuracy(forecast).first()
    assert accuracy["mae"] == 0 and accuracy["wape"] == 0 and accuracy["bias"] == 0
    assert 0 < accuracy["forecast_rows_evaluated"] < 6 * 28 * 2


def test_moving_average_is_flat(series):
    forecast = fc.moving_average_forecast(series, SPEC, origins(), window_days=7)
    values = {(r["item"], r["forecast"]) for r in forecast.collect()}
    assert sorted(values) == [("A", 5.0), ("B", 20.0)]


def brute_force(frame, origin, horizon, hi, model):
    """Predictions of one series by slicing its history."""
    history = frame[frame.index < pd.Timestamp(origin)]
    out = []
    for h in range(horizon):
        target = pd.Timestamp(origin) + pd.Timedelta(days=h)
        if model == "moving_average":
            out.append(history.tail(28).mean())
            continue
        dates = [target - pd.Timedelta(days=7 * j) for j in range(1, 60)]
        picks = [history[d] for d in dates if d in history.index][:4]
        out.append(np.mean(picks) if picks else 0.0)
    return out


@pytest.mark.parametrize("model", ["moving_average", "seasonal_naive"])
def test_against_brute_force_beyond_the_data_and_on_short_history(spark, model):
    first, last = dt.date(2020, 1, 1), dt.date(2020, 2, 15)
    days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    rng = np.random.default_rng(5)
    values = {e: rng.integers(0, 20, len(days)) for e in "XYZ"}
    rows = [(d, e, "s", int(v)) for e, vs in values.items() for d, v in zip(days, vs)]
    grid = spark.createDataFrame(rows, "date date, item string, site string, quantity bigint")
    start, end = dt.date(2020, 1, 4), dt.date(2020, 3, 7)  # 3 days of history first; last origins after the data
    make = {"moving_average": fc.moving_average_forecast, "seasonal_naive": fc.seasonal_naive_forecast}[model]
    got = {(r["item"], r["origin_date"], r["date"]): r["forecast"] for r in make(grid, SPEC, origins(start, end, first, last)).collect()}
    expected = {}
    for e, vs in values.items():
        frame = pd.Series(vs.astype(float), index=pd.to_datetime(days))
        origin = start
        while origin <= end:
            for h, v in enumerate(brute_force(frame, origin, 28, last, model)):
                expected[(e, origin, origin + dt.timedelta(days=h))] = v
            origin += dt.timedelta(days=7)
    assert set(got) == set(expected)
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_an_origin_without_history_is_an_error(series):
    for make in (fc.seasonal_naive_forecast, fc.moving_average_forecast):
        with pytest.raises(PySparkException, match="no observations before"):
            make(series, SPEC, origins(start=DAYS[0])).collect()


def test_no_look_ahead(series):
    cut = dt.date(2016, 1, 18)
    changed = series.withColumn("quantity", F.when(F.col("date") >= F.lit(cut), 1000).otherwise(F.col("quantity")))
    for make in (fc.seasonal_naive_forecast, fc.moving_average_forecast):
        a, b = (make(g, SPEC, origins()) for g in (series, changed))
        same = fc.compare_forecasts(a.where(F.col("origin_date") <= F.lit(cut)), b.where(F.col("origin_date") <= F.lit(cut)), SPEC).first()
        later = fc.compare_forecasts(a, b, SPEC).first()
        assert (same["compared_rows"], same["differing_rows"]) == (3 * 28 * 2, 0)
        assert later["differing_rows"] > 0


def test_features_match_slices(series):
    origin = series.sparkSession.createDataFrame([(START,)], "origin_date date")
    rows = fc.forecast_features(series, SPEC, origin, LAST).where("item = 'A'").orderBy("horizon_day").collect()
    history = [WEEK[d.weekday()] for d in DAYS if d < START]
    assert len(rows) == 28
    for h, r in enumerate(rows):
        target = START + dt.timedelta(days=h)
        assert (r["date"], r["horizon_day"], r["weekday"], r["month"]) == (target, h, target.weekday(), target.month)
        assert r["last_value"] == history[-1]
        assert r["mean_7"] == pytest.approx(np.mean(history[-7:])) and r["mean_28"] == pytest.approx(np.mean(history[-28:]))
        assert r["mean_365"] == pytest.approx(np.mean(history[-365:])) and r["mean_same_weekday_4"] == WEEK[target.weekday()]


def test_training_set_and_model(spark, series):
    bounds = spark.createDataFrame([(DAYS[0], LAST)], "lo date, hi date")
    training = fc.training_set(series, SPEC, bounds, START, window_days=200)
    assert training.agg(F.max("date")).first()[0] == START - dt.timedelta(days=1)
    assert training.select("origin_date").distinct().count() == (200 - 28) // 7 + 1
    forecast = fc.learned_forecast(series, SPEC, bounds, origins(), window_days=200)
    accuracy = fc.forecast_accuracy(fc.attach_actuals(forecast, series, SPEC)).first()
    assert accuracy["wape"] < 0.05
    short = spark.createDataFrame([(START - dt.timedelta(days=40), LAST)], "lo date, hi date")
    with pytest.raises(PySparkException, match="at least 56 days"):
        fc.training_origins(short, SPEC, START).collect()


def test_origin_errors_and_empty_accuracy(spark):
    bounds = spark.createDataFrame([(START, END)], "lo date, hi date")
    assert [r[0] for r in spine.origin_spine(bounds, F.col("lo"), F.col("hi"), 7).collect()][-1] == dt.date(2016, 2, 8)
    with pytest.raises(PySparkException, match="before its start"):
        spine.origin_spine(bounds, F.col("hi"), F.col("lo"), 7).collect()
    empty = spark.createDataFrame([(1.0, None)], "forecast double, actual double")
    row = fc.forecast_accuracy(empty).first()
    assert row["forecast_rows_evaluated"] == 0 and row["mae"] is None and row["wape"] is None
    zero = spark.createDataFrame([(1.0, 0.0)], "forecast double, actual double")
    assert fc.forecast_accuracy(zero).first()["bias"] is None


def test_trailing_means_do_not_depend_on_partitions(series):
    expected = None
    for parts in (1, 7, 64):
        rows = sorted(tuple(r) for r in trailing_means(series.repartition(parts), ["item", "site"], (7, 28)).select("date", "item", "mean_7", "mean_28").collect() if r["mean_7"] is not None)
        assert expected is None or rows == expected
        expected = rows
