"""A scenario end to end on a small synthetic history."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.operators.quality import report_passed, validate_bundle
from stockweave.plans.pipeline import ScenarioRun, run_scenario
from stockweave.schema import CANONICAL


@pytest.fixture(scope="module")
def retail(spark):
    rng = np.random.default_rng(2)
    start = dt.date(2014, 1, 1)
    rows = []
    for p, level in (("A", 12), ("B", 3)):
        for s in ("S1", "S2"):
            for i in range(500):
                d = start + dt.timedelta(days=i)
                rows.append((d, p, s, int(rng.poisson(level * (1.4 if d.weekday() > 4 else 0.9)))))
    prices = [(w, p, s, 2.0 + w) for w in range(3) for p in "AB" for s in ("S1", "S2")]
    return {
        "sales": spark.createDataFrame(rows, "date date, product_id string, store_id string, quantity bigint"),
        "price": spark.createDataFrame(prices, "week_id bigint, product_id string, store_id string, unit_price double"),
    }


def test_baseline_and_shock(spark, retail, tmp_path):
    base = run_scenario(retail, ScenarioRun(), str(tmp_path / "base"))
    shock = run_scenario(retail, ScenarioRun("demand_shock"), str(tmp_path / "shock"))
    last = dt.date(2014, 1, 1) + dt.timedelta(days=499)
    assert base["synthetic_demand"].agg(F.min("date"), F.count(F.lit(1))).first() == (last + dt.timedelta(days=1), 4 * 91)
    assert base["forecast_accuracy"].first()["wape"] < 0.6
    window = [last + dt.timedelta(days=29 + i) for i in range(14)]
    ratio = [run["synthetic_demand"].where(F.col("date").isin(window)).agg(F.sum("quantity")).first()[0] for run in (shock, base)]
    assert ratio[0] / ratio[1] == pytest.approx(2.5, rel=0.25)
    assert base["levels_safety_stock"].where("order_up_to > reorder_point AND safety_stock > 0").count() == 4
    assert base["levels_order_up_to"].where("order_up_to IS NOT NULL").count() == 4 * 7
    assert {(r["parameter"], r["status"]) for r in shock["scenario_parameters"].collect()} == {(f"shock_{n}", "applied") for n in ("multiplier", "start_day", "duration_days")}
    names = {"demand_timeline": "derived.demand_timeline", "synthetic_demand": "ops.synthetic_demand", "forecast": "sim.forecast"}
    report = validate_bundle({n: (CANONICAL[i], base[n].select(*CANONICAL[i].names)) for n, i in names.items()})
    assert report_passed(report).first()["passed"], report.where("status = 'failed'").collect()


def test_settings_are_checked(retail, tmp_path):
    with pytest.raises(ValueError, match="unknown scenario"):
        ScenarioRun("storm").parameters()
    with pytest.raises(ValueError, match="unknown forecast model"):
        run_scenario(retail, ScenarioRun(forecast_model="oracle"), str(tmp_path / "x"))
