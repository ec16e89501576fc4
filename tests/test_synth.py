"""Calibration, scenarios, generated tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stockweave.operators.aggregates import active_history_mean, demand_stats, mean_daily_demand
from stockweave.operators.windows import distributed_rank
from stockweave.plans import calibrate, operations, report, scenarios, synth

WEEK = (0.8, 0.8, 0.8, 0.8, 1.0, 1.4, 1.4)
ENTITY = ["item", "site"]


def days(start, n):
    return [start + dt.timedelta(days=i) for i in range(n)]


@pytest.fixture(scope="module")
def history(spark):
    """A sells from day 100 on, B all along, C never."""
    rng = np.random.default_rng(11)
    rows = []
    for item, level in (("A", 10), ("B", 4), ("C", 0)):
        for i, d in enumerate(days(dt.date(2014, 1, 1), 800)):
            rate = level * WEEK[d.weekday()] * (1.2 if d.month in (6, 7) else 1.0)
            rows.append((d, item, "s", 0 if item == "A" and i < 100 else int(rng.negative_binomial(5, 5 / (5 + rate))) if rate else 0))
    return spark.createDataFrame(rows, "date date, item string, site string, quantity bigint").cache()


def expected_profile(frame, end, window):
    sold = frame[frame.quantity > 0].date
    if sold.empty:
        return 0.0, [1.0] * 7, [1.0] * 12, 10.0
    start = max(sold.min(), end - pd.Timedelta(days=window - 1))
    active = frame[frame.date >= start]
    level = active.quantity.mean()

    def factors(keys, count, base):
        means = (active.groupby(keys).quantity.mean() / level).to_dict()
        scale = np.mean(list(means.values()))
        return [round(means[k] / scale, 6) if k in means else 1.0 for k in range(base, base + count)]

    weekly = factors(active.date.dt.dayofweek, 7, 0)
    monthly = factors(active.date.dt.month, 12, 1)
    fit = level * np.array(weekly)[active.date.dt.dayofweek] * np.array(monthly)[active.date.dt.month - 1]
    excess = ((active.quantity - fit) ** 2 - fit).sum()
    return round(level, 6), weekly, monthly, round(min(max((fit**2).sum() / excess, 0.05), 1e6), 6) if excess > 0 else 1e6


@pytest.mark.parametrize("window", [730, 120])
def test_profiles_against_a_loop(history, window):
    frame = history.toPandas()
    frame["date"] = pd.to_datetime(frame["date"])
    end = frame.date.max()
    got = {r["item"]: r for r in calibrate.calibrate_profiles(history, ENTITY, end.date(), window).collect()}
    for item in "ABC":
        level, weekly, monthly, dispersion = expected_profile(frame[frame["item"] == item], end, window)
        assert got[item]["level"] == pytest.approx(level, abs=1e-9)
        assert got[item]["weekly"] == pytest.approx(weekly, abs=2e-6) and got[item]["monthly"] == pytest.approx(monthly, abs=2e-6)
        assert got[item]["dispersion"] == pytest.approx(dispersion, rel=1e-4)


def test_mean_demand_excludes_leading_zeros(spark):
    rows = [(d, "A", "s", 0 if i < 10 else 2) for i, d in enumerate(days(dt.date(2024, 1, 1), 20))] + [(dt.date(2024, 1, 5), "Z", "s", 0), (dt.date(2024, 1, 2), "E", "s", 6)]
    df = spark.createDataFrame(rows, "date date, item string, site string, quantity bigint")
    assert {r["item"]: r["mean_daily_demand"] for r in mean_daily_demand(df, 365, dt.date(2024, 1, 20), ENTITY).collect()} == {"A": 2.0, "Z": 0.0, "E": 6.0}
    own = {r["item"]: r["mean_demand"] for r in active_history_mean(df, 5, ENTITY).collect()}
    last = {r["item"]: r["mean_daily_demand"] for r in mean_daily_demand(df, 5, dt.date(2024, 1, 20), ENTITY).collect()}
    assert own["E"] == 6.0 and last["E"] == 0.0  # own last day against the table's last day


PROFILES = [("A", "s", 10.0, list(WEEK), [1.0] * 12, 5.0), ("B", "s", 4.0, list(WEEK), [1.0] * 12, 5.0), ("N", "s", 0.0, [1.0] * 7, [1.0] * 12, 10.0)]
START = dt.date(2016, 1, 4)


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame(PROFILES, "item string, site string, level double, weekly array<double>, monthly array<double>, dispersion double").cache()


def test_noise_free_scenarios(profiles):
    names = {n: calibrate.effects_from({**p, "noise_scale": 0.0}, scenarios.DEMAND_MAPPING)[0] for n, p in scenarios.SCENARIOS.items()}
    demand = synth.scenario_demand(profiles, names, START, 91, 1, ENTITY).cache()
    base = demand.where("scenario_id = 'baseline' AND item = 'A'").orderBy("date").collect()
    assert [r["quantity"] for r in base] == [round(10 * WEEK[r["date"].weekday()]) for r in base] and len(base) == 91
    assert demand.where("item = 'N'").agg(F.sum("quantity")).first()[0] == 0
    ratios = {r["scenario_id"]: r for r in report.scenario_ratio(demand, "baseline", 28, 14).collect()}
    assert ratios["demand_shock"]["inside_ratio"] == pytest.approx(2.5) and ratios["demand_shock"]["outside_ratio"] == 1.0
    assert ratios["supply_disruption"]["total_ratio"] == 1.0 and ratios["high_demand"]["total_ratio"] > 1.2


def test_sampling_moments_and_common_numbers(profiles):
    effects = {"a": calibrate.Effects(), "b": calibrate.Effects(level_multiplier=1.3)}
    rows = synth.scenario_demand(profiles, effects, START, 3000, 1, ENTITY).where("item = 'A'").toPandas()
    wide = rows.pivot(index="date", columns="scenario_id", values="quantity")
    assert (wide["b"] >= wide["a"]).all()
    assert wide["a"].mean() == pytest.approx(10, rel=0.05) and wide["b"].mean() / wide["a"].mean() == pytest.approx(1.3, rel=0.02)
    again = synth.scenario_demand(profiles.repartition(7), effects, START, 3000, 1, ENTITY).where("item = 'A'").toPandas()
    assert again.pivot(index="date", columns="scenario_id", values="quantity").equals(wide)
    poisson = synth.scenario_demand(profiles, {"a": calibrate.Effects()}, START, 3000, 1, ENTITY, distribution="poisson").where("item = 'B'").toPandas()
    assert poisson.quantity.mean() == pytest.approx(4, rel=0.05)
    with pytest.raises(ValueError):
        synth.sample_demand(profiles, 1, ENTITY, distribution="uniform")


def test_effects():
    effects, applied, unused = calibrate.effects_from({"demand_multiplier": 1.3, "lead_time_delta": 7}, scenarios.DEMAND_MAPPING)
    assert effects.level_multiplier == 1.3 and applied == ["demand_multiplier"] and unused == ["lead_time_delta"]
    with pytest.raises(ValueError, match="unknown"):
        calibrate.effects_from({}, {"volume": "x"})
    with pytest.raises(ValueError):
        calibrate.Effects(noise_scale=-1)


def test_timeline(spark, profiles):
    observed = spark.createDataFrame([(START - dt.timedelta(days=1), i, "s", 5) for i in "AQ"], "date date, item string, site string, quantity bigint")
    horizon = synth.scenario_demand(profiles, {"x": calibrate.Effects(noise_scale=0.0)}, START, 2, 1, ENTITY)
    rows = synth.union_timeline(observed, horizon, ENTITY).collect()
    assert sorted((r["item"], r["origin"]) for r in rows if r["origin"] == "observed") == [("A", "observed")] and len(rows) == 7
    with pytest.raises(PySparkException, match="inside the observed history"):
        synth.union_timeline(observed.withColumn("date", F.lit(START)), horizon, ENTITY).collect()


def test_rules(spark):
    reference = spark.createDataFrame([(i, f"n{i}") for i in range(1, 51)], "k int, name string")
    rules = {
        "supplier_id": synth.numbered(prefix="SUP"), "tier": synth.choice(("A", "B"), (0.8, 0.2)), "capacity": synth.uniform(10, 20, integer=True),
        "order_cost": synth.constant(25), "rush_cost": synth.linear("order_cost", 1.5, 2.0, decimals=2), "label": synth.lookup("tier", {"A": "gold"}, "plain"),
        "name": synth.copied("name"),
    }
    rows = synth.generate_table(reference, rules, 5, ["k"]).orderBy("supplier_id").collect()
    assert [r["supplier_id"] for r in rows] == [f"SUP{i:03d}" for i in range(1, 51)] and rows[49]["name"] == "n50"
    assert {r["rush_cost"] for r in rows} == {39.5} and all(10 <= r["capacity"] <= 20 for r in rows)
    assert all((r["label"] == "gold") == (r["tier"] == "A") for r in rows) and {r["tier"] for r in rows} == {"A", "B"}
    with pytest.raises(ValueError, match="unknown source"):
        synth.generate_table(reference, {"x": synth.linear("missing")}, 5, ["k"])


def test_drawn_columns_and_their_flags(spark):
    rules = {"a": synth.drawn("gamma", 2.0, 3.0, high=9.0), "b": synth.drawn("poisson", 4.0, low=1, high=6, integer=True)}
    rows = synth.generate_table(spark.range(400).withColumnRenamed("id", "k"), rules, 5, ["k"], flags=True).collect()
    assert all(r["a"] <= 9 and 1 <= r["b"] <= 6 for r in rows) and {r["a_clipped"] for r in rows} == {True, False} == {r["b_clipped"] for r in rows}
    assert all(r["a"] == 9 for r in rows if r["a_clipped"])
    for refused in (lambda: synth.drawn("cauchy", 1.0), lambda: synth.drawn("normal", 0.0, 1.0, low=2, high=1), lambda: synth.uniform(2, 1)):
        with pytest.raises(ValueError):
            refused()


def test_rank_of_a_hot_value(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("v"))
    rows = distributed_rank(df, [F.col("v"), F.col("id")], partitions=8).collect()
    ordered = sorted(rows, key=lambda r: (r["v"], r["id"]))
    assert [r["rank"] for r in ordered] == list(range(1, 3001))


def test_rank_correlation(spark):
    df = spark.range(4000).select("id", synth.normal(3, "a", [F.col("id")], 0, 1).alias("a"), synth.lognormal(3, "b", [F.col("id")], 0, 0.5).alias("b"))
    out = synth.rank_correlate(df, ["id"], ["a", "b"], [[1.0, 0.7], [0.7, 1.0]], 9).toPandas()
    before = df.toPandas()
    assert sorted(out.a) == sorted(before.a) and sorted(out.b) == sorted(before.b)
    assert out[["a", "b"]].rank().corr().iloc[0, 1] == pytest.approx(0.68, abs=0.04)
    for bad in ([[1.0, 0.5], [0.4, 1.0]], [[1.0, 1.0], [1.0, 1.0]], [[2.0, 0.0], [0.0, 1.0]]):
        with pytest.raises(ValueError):
            synth.cholesky(bad)


def test_operations(spark, history):
    sales = history.withColumnsRenamed({"item": "product_id", "site": "store_id"})
    price = spark.createDataFrame([(1, i, "s", p) for i, p in (("A", 2.0), ("B", 3.5), ("C", 1.0))], "week_id bigint, product_id string, store_id string, unit_price double")
    tables = operations.generate_operations(spark, sales, price, 1, dt.date(2016, 3, 10))
    from stockweave.operators.quality import report_passed, validate_bundle
    from stockweave.schema import CANONICAL

    ids = {n: (f"derived.{n}" if f"derived.{n}" in CANONICAL else f"ops.{n}") for n in tables}
    checked = validate_bundle({n: (CANONICAL[ids[n]], df.select(*CANONICAL[ids[n]].names)) for n, df in tables.items()})
    failed = [tuple(r) for r in checked.where("status = 'failed'").collect()]
    assert report_passed(checked).first()["passed"], failed
    assert tables["supplier"].count() == 5 and tables["initial_inventory"].count() == 3
    with pytest.raises(ValueError, match="overlap"):
        operations.hybrid_tables({"supplier": None}, tables)


def test_demand_stats(spark):
    rows = [(d, "A", 2) for d in days(dt.date(2024, 1, 1), 14)] + [(d, "B", 4 * (i % 2)) for i, d in enumerate(days(dt.date(2024, 1, 1), 14))]
    stats = demand_stats(spark.createDataFrame(rows, "date date, item string, quantity bigint"), ["item"]).first()
    assert (stats["series"], stats["days"], stats["mean_units"], stats["zero_share"]) == (2, 14, 2.0, 0.25)


def test_events_flags_and_the_scenario_report(spark, profiles):
    from stockweave.plans import scenarios

    events = spark.createDataFrame([(START,), (START,)], "date date")
    effects = {"plain": calibrate.Effects(noise_scale=0.0), "steep": calibrate.Effects(noise_scale=0.0, seasonality_multiplier=8.0)}
    without = synth.scenario_demand(profiles, effects, START, 28, 1, ENTITY)
    flagged = synth.scenario_demand(profiles, effects, START, 28, 1, ENTITY, events=events, event_multiplier=3.0, flags=True).cache()
    assert without.columns == ["date", *ENTITY, "quantity", "scenario_id", "day_index"] and flagged.columns[-2:] == ["season_clipped", "on_event"]
    keys = ["date", *ENTITY, "scenario_id"]
    both = flagged.join(without.withColumnRenamed("quantity", "usual"), keys).toPandas()
    first = both["on_event"]
    assert first.sum() == (both["date"] == START).sum() > 0 and (both.loc[~first, "quantity"] == both.loc[~first, "usual"]).all()
    assert (abs(both.loc[first, "quantity"] - 3 * both.loc[first, "usual"]) <= 1.5).all()
    parameters = scenarios.parameter_table(spark, {"plain": {"noise_scale": 2.0, "colour": 1.0, "area": 2.0}, "steep": {"seasonality_multiplier": 8.0}})
    mapping = scenarios.effect_mapping(spark)
    report = {r["scenario_id"]: r for r in scenarios.scenario_report(flagged, parameters, mapping, "poisson").collect()}
    assert report["plain"]["unused"] == "area,colour" and "noise_scale" in report["plain"]["warning"] and report["steep"]["warning"] == ""
    assert report["plain"]["clipped_rows"] == 0 < report["steep"]["clipped_rows"] and report["steep"]["event_rows"] == first.sum() / 2
    assert {r["warning"] for r in scenarios.scenario_report(flagged, parameters, mapping).collect()} == {""}
