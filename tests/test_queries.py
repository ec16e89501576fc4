"""Registered queries against DuckDB on the smallest tables, and the driver contract."""

import importlib.util
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

sys.path.insert(0, os.path.join(ROOT, "scripts"))


def load(name, path):
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def contract():
    return load("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


SAMPLE = ("observed_grid", "backtest_accuracy", "calibrate_profiles", "forecast_features", "stock_ledger_rollforward", "inventory_kpis", "levels_safety_stock",
          "validate_bundle", "rank_correlate", "scenario_demand", "content_fingerprint", "subset_extract", "no_look_ahead_check", "build_operations")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, contract, duck, name):
    compare = load("verify_oracle", os.path.join(ROOT, "scripts", "verify_oracle.py"))
    got, want = contract.queries()[name](spark, SF).toPandas(), duck.sql(contract.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert compare.rows_of(got, columns) == compare.rows_of(want, columns)


def test_contract(spark, contract):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    from stockweave import queries as core

    assert set(core.QUERIES) <= set(contract.queries())
    rows_only = set(core.QUERIES) - set(contract.oracle_sql())
    assert rows_only == {"forecast_ml", "sample_demand", "gen_gamma", "gen_poisson", "gen_negative_binomial", "scenario_demand_noisy"}
    assert contract.entry(spark).columns[:2] == ["model", "origin_date"]


def test_noisy_scenarios_share_their_draws(spark, contract):
    rows = contract.queries()["scenario_demand_noisy"](spark, SF).toPandas()
    wide = rows.pivot(index=["date", "product_id", "store_id"], columns="scenario_id", values="quantity")
    assert (wide["high_demand"].sum() > wide["baseline"].sum()) and wide["baseline"].std() > 0
    quiet = contract.queries()["scenario_demand"](spark, SF).toPandas()
    assert abs(rows["quantity"].sum() / quiet["quantity"].sum() - 1) < 0.1
