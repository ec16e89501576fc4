"""Ledgers, KPIs, levels and orders against hand-computed cases and loops."""

import datetime as dt
from math import sqrt
from statistics import NormalDist, stdev

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stockweave.operators import joins as J
from stockweave.operators import ledger as L
from stockweave.plans import kpis as K
from stockweave.plans import planning as P
from stockweave.plans import report as R

DAY0 = dt.date(2024, 1, 1)
MOVES = "date date, product_id string, warehouse_id string, arrivals bigint, demand bigint, opening_units bigint"


def day(n):
    return DAY0 + dt.timedelta(days=n)


def ledger_of(spark, arrivals, demand, opening, product="P"):
    rows = [(day(i), product, "W", int(a), int(d), opening) for i, (a, d) in enumerate(zip(arrivals, demand))]
    return L.stock_ledger(spark.createDataFrame(rows, MOVES)).orderBy("date")


def test_ten_day_ledger(spark):
    rows = ledger_of(spark, (0, 0, 5, 3, 3, 3, 3, 3, 3, 3), (3,) * 10, 10).collect()
    assert [r["closing_on_hand"] for r in rows] == [7, 4, 6, 6, 6, 6, 6, 6, 6, 6]
    assert sum(r["lost_sales"] for r in rows) == 0


def test_ledger_equals_the_daily_loop(spark):
    rng = np.random.default_rng(3)
    for _ in range(3):
        arrivals, demand, opening = rng.integers(0, 6, 120), rng.integers(0, 7, 120), int(rng.integers(0, 20))
        rows = ledger_of(spark, arrivals, demand, opening).collect()
        stock = opening
        for r, a, d in zip(rows, arrivals, demand):
            assert r["opening_on_hand"] == stock + a
            sold = min(stock + a, d)
            stock = stock + a - sold
            assert (r["fulfilled"], r["lost_sales"], r["closing_on_hand"]) == (sold, d - sold, stock)


def test_identities_and_positions(spark):
    rng = np.random.default_rng(4)
    ledger = ledger_of(spark, rng.integers(0, 6, 60), rng.integers(0, 7, 60), 5)
    orders = spark.createDataFrame([("P", "W", day(3), day(9), 6), ("P", "W", day(5), None, 4)], "product_id string, warehouse_id string, order_date date, received_date date, shipped_qty bigint")
    placed = L.with_position(ledger, L.on_order(L.order_movements(orders)))
    assert {r["rule"]: r["violations"] for r in L.identity_violations(placed).collect()} == dict.fromkeys(("opening", "demand_split", "closing", "position", "non_negative"), 0)
    outstanding = {r["date"]: r["on_order"] for r in placed.collect()}
    assert [outstanding[day(i)] for i in (2, 3, 5, 8, 9, 59)] == [0, 6, 10, 10, 4, 4]
    broken = placed.withColumn("closing_on_hand", F.col("closing_on_hand") + F.when(F.col("date") == F.lit(day(7)), 1).otherwise(0))
    assert sum(r["violations"] for r in L.identity_violations(broken).collect()) >= 2


DEMAND = (3, 8, 0, 9, 4, 7, 2, 6, 5, 10, 1, 3, 7, 4)


def test_kpis_from_the_ledger(spark):
    ledger = ledger_of(spark, (0,) * 14, DEMAND, 40)
    rows = ledger.collect()
    orders = spark.createDataFrame([("S", 20), ("S", 10)], "supplier_id string, quantity bigint")
    costs = spark.createDataFrame([("P", "W", 1.0, 2.0, 0.365)], "product_id string, warehouse_id string, unit_cost double, unit_price double, holding_cost_rate_annual double")
    fees = spark.createDataFrame([("S", 10.0)], "supplier_id string, order_cost double")
    k = K.inventory_kpis(ledger, K.order_totals(orders), costs, fees, 14).first()
    stock, lost, sold = (sum(r[c] for r in rows) for c in ("closing_on_hand", "lost_sales", "fulfilled"))
    assert k["demand_total"] == sum(DEMAND) and k["fill_rate"] == pytest.approx(sold / sum(DEMAND))
    assert k["stockout_days"] == sum(r["lost_sales"] > 0 for r in rows) and k["stockout_day_rate"] == pytest.approx(k["stockout_days"] / 14)
    assert k["avg_on_hand_units"] == pytest.approx(stock / 14) and k["holding_cost"] == pytest.approx(stock * 0.001)
    assert k["inventory_turnover"] == pytest.approx(sold / (stock / 14) * 365 / 14)
    assert (k["purchase_orders"], k["units_ordered"], k["order_frequency"], k["ordering_cost"]) == (2, 30, 1.0, 20.0)
    assert k["total_cost"] == pytest.approx(20 + stock * 0.001 + 2 * lost)
    rows = {r["metric_id"]: r["value"] for r in K.metric_rows(K.inventory_kpis(ledger, K.order_totals(orders), costs, fees, 14)).collect()}
    assert list(rows) == list(K.KPI_UNITS)
    with pytest.raises(PySparkException, match="cost data missing"):
        K.inventory_kpis(ledger, K.order_totals(orders), costs.where("product_id = 'Q'"), fees, 14).collect()


def test_zero_demand_has_no_ratios(spark):
    ledger = ledger_of(spark, (0,) * 7, (0,) * 7, 0)
    costs = spark.createDataFrame([("P", "W", 1.0, 2.0, 0.3)], "product_id string, warehouse_id string, unit_cost double, unit_price double, holding_cost_rate_annual double")
    none = spark.createDataFrame([], "supplier_id string, quantity bigint")
    fees = spark.createDataFrame([], "supplier_id string, order_cost double")
    k = K.inventory_kpis(ledger, K.order_totals(none), costs, fees, 7).first()
    assert k["fill_rate"] is None and k["inventory_turnover"] is None and k["purchase_orders"] == 0 and k["ordering_cost"] == 0
    assert [tuple(r) for r in K.fill_rate_by_scope(ledger).collect() if r["scope"] == "total"] == [("total", None)]


@pytest.fixture
def view(spark):
    rows = [("I", day(0), day(h), 5.0, 6.0) for h in range(28)] + [("I", day(7), day(7 + h), 7.0, 6.0) for h in range(28)]
    return spark.createDataFrame(rows, "item string, origin_date date, date date, forecast double, actual double")


def test_forecast_in_force(spark, view):
    days = spark.createDataFrame([("I", day(2), 5), ("I", day(7), 5), ("I", day(9), 3), ("I", day(5), 25), ("I", dt.date(2023, 12, 30), 3)], "item string, day date, n int")
    got = {r["day"]: (r["origin_date"], r["covered_days"], r["total"]) for r in P.forecast_total_ahead(days, view, ["item"], F.col("n")).collect()}
    assert got[day(2)] == (day(0), 5, 25.0) and got[day(7)] == (day(7), 5, 35.0) and got[day(9)] == (day(7), 3, 21.0)
    assert got[day(5)] == (day(0), 23, None) and got[dt.date(2023, 12, 30)] == (None, 0, None)
    errors = P.errors_in_use(view, ["item"])
    window = spark.createDataFrame([("I", day(11))], "item string, day date")
    used = P.errors_before(window, errors, ["item"], 6).orderBy("date").collect()
    assert [r["error"] for r in used] == [-1.0, -1.0, 1.0, 1.0, 1.0, 1.0]
    spread = P.error_std(window, errors, ["item"], 6).first()
    assert spread["errors"] == 6 and spread["error_std"] == pytest.approx(stdev([-1, -1, 1, 1, 1, 1]))
    early = P.error_std(spark.createDataFrame([("I", day(1))], "item string, day date"), errors, ["item"], 6).first()
    assert early["errors"] == 1 and early["error_std"] is None


def test_levels(spark):
    means = spark.createDataFrame([("I", 3.0)], "item string, mean_demand double")
    items = spark.createDataFrame([("I", 2.0, 14), ("J", 2.0, 14)], "item string, lead_time_mean_days double, order_cycle_days int")
    got = {r["item"]: (r["reorder_point"], r["order_quantity"]) for r in P.reorder_point_levels(means, items, ["item"]).collect()}
    assert got == {"I": (6.0, 42.0), "J": (0.0, 0.0)}
    pattern = [1.0, -1.0, 2.0, 0.0] * 14
    rows = [("I", day(7 * w), day(7 * w + h), 5.0, 5.0 - pattern[(7 * w + h) % 56]) for w in range(9) for h in range(28)]
    forecast = spark.createDataFrame(rows, "item string, origin_date date, date date, forecast double, actual double")
    today = spark.createDataFrame([("I", day(56), 2.0, 14, 0.95)], "item string, day date, lead_time_mean_days double, order_cycle_days int, target_service_level double")
    z, sigma = NormalDist().inv_cdf(0.95), stdev(pattern)
    level = P.safety_stock_levels(today, forecast, ["item"]).first()
    assert level["reorder_point"] == pytest.approx(10 + z * sigma * sqrt(2)) and level["order_up_to"] == pytest.approx(level["reorder_point"] + 70)
    assert P.order_up_to_levels(today, forecast, ["item"]).first()["order_up_to"] == pytest.approx(80 + z * sigma * 4)


def test_order_sizes(spark):
    df = spark.createDataFrame([(-1.0, 6, 12), (0.0, 6, 12), (3.0, 6, 12), (13.0, 6, 12), (24.0, 0, 12), (5.0, 30, 24)], "raw double, moq int, pack int")
    assert [r[0] for r in df.select(P.rounded_order(F.col("raw"), F.col("moq"), F.col("pack"))).collect()] == [0, 0, 12, 24, 24, 48]
    pos = spark.createDataFrame([(5.0,), (6.0,), (7.0,), (200.0,)], "p double")
    p, s, q, up = F.col("p"), F.lit(6.0), F.lit(42.0), F.lit(80.0)
    rows = pos.select(P.recommend_fixed_quantity(p, s, q), P.recommend_up_to_when_low(p, s, up), P.recommend_up_to(p, up)).collect()
    assert [tuple(r) for r in rows] == [(42, 75, 75), (42, 74, 74), (0, 0, 73), (0, 0, 0)]


def test_order_status(spark):
    ddl = "po_id string, quantity bigint, shipped_qty bigint, expected_arrival_date date"
    orders = spark.createDataFrame([("a", 10, 0, day(1)), ("b", 10, 10, day(10)), ("c", 10, 5, day(9)), ("d", 10, 10, day(9))], ddl)
    got = {r["po_id"]: (r["status"], r["received_date"]) for r in P.order_status(orders, day(9)).collect()}
    assert got == {"a": ("not_shipped", None), "b": ("open", None), "c": ("partially_received", day(9)), "d": ("received", day(9))}


def test_lead_times_react_only_to_the_scenario(spark):
    orders = spark.range(400).select(F.col("id").cast("string").alias("po_id"), F.lit(6.0).alias("lead_time_mean_days"), F.lit(1.0).alias("lead_time_std_days"), F.lit(0.9).alias("on_time_probability"), F.lit(DAY0).alias("order_date"))
    base, late = (P.order_lead_time(orders, 1, F.lit(flag), 7).collect() for flag in (False, True))
    assert all(b["sampled_lead_time_days"] + 7 == x["sampled_lead_time_days"] or b["sampled_lead_time_days"] <= 4 for b, x in zip(base, late))
    assert min(r["sampled_lead_time_days"] for r in base) >= 1


def test_capacity_coverage_and_checks(spark):
    ledger = ledger_of(spark, (0,) * 3, (1, 1, 1), 10)
    house = spark.createDataFrame([("W", 8)], "warehouse_id string, capacity_units bigint")
    assert [r["date"] for r in L.capacity_breaches(ledger, house).collect()] == [day(0)]
    demand = ledger.where(F.col("date") != F.lit(day(1)))
    assert L.horizon_coverage(demand, ledger, day(0), day(2)).first()["missing_days"] == 1
    values = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (-2.0,)], "forecast double")
    assert tuple(P.invalid_forecasts(values).first()) == (4, 1, 1, 1)


def test_joins(spark):
    facts = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("b", 4)], "k string, v int")
    dim = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "k string, w string")
    with pytest.raises(PySparkException, match="not unique"):
        J.many_to_one(facts, dim, ["k"]).collect()
    with pytest.raises(PySparkException, match="not unique"):
        J.many_to_one(facts, dim, ["k"], hot_left=False).collect()
    assert J.many_to_one(facts, dim.where("w <> 'z'"), ["k"], "left").where("w IS NULL").count() == 1
    assert [tuple(r) for r in J.orphan_keys(facts, ["k"], dim.where("k = 'a'"), ["k"]).collect()] == [("b", 2)]
    sides = {r["k"]: r["side"] for r in J.keyset_compare(dim.select("k"), spark.createDataFrame([("a",), ("c",)], "k string"), ["k"]).collect()}
    assert sides == {"b": "missing", "c": "unexpected"}
    left = spark.createDataFrame([("e", day(n), n) for n in (0, 3, 3, 9)], "e string, d date, n int")
    right = spark.createDataFrame([("e", day(2)), ("e", day(8))], "e string, o date")
    got = sorted((r["n"], r["o"]) if r["o"] else (r["n"], DAY0) for r in J.asof_latest(left, right, ["e"], "d", "o").collect())
    assert got == [(0, DAY0), (3, day(2)), (3, day(2)), (9, day(8))]


def test_reports(spark):
    rows = spark.createDataFrame([("base", "v", "total_cost", 10.0), ("base", "v", "fill_rate", 0.0), ("what_if", "v", "total_cost", 15.0), ("what_if", "v", "fill_rate", 0.5)], "run_id string, variant string, metric_id string, value double")
    delta = {r["metric_id"]: (r["delta"], r["ratio"]) for r in R.metric_delta(rows, "base").collect()}
    assert delta == {"total_cost": (5.0, 1.5), "fill_rate": (0.5, None)}
    assert R.run_comparison(rows, ["what_if"], ["total_cost"]).first()["total_cost"] == 15.0
    assert tuple(R.variant_run_table(rows, "total_cost", ["base", "what_if"]).first()) == ("v", 10.0, 15.0)
