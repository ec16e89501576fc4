"""Month cells against the full run, accuracy sums, transitive lineage and ranks within groups."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stockweave.operators import lineage
from stockweave.operators import windows as X
from stockweave.plans import calibrate, state
from stockweave.plans import forecast as fc
from stockweave.sources import versions

FIRST, LAST = dt.date(2020, 1, 1), dt.date(2021, 6, 30)


@pytest.fixture(scope="module")
def grid(spark):
    days = spark.createDataFrame([(FIRST, LAST)], "lo date, hi date").select(F.explode(F.sequence("lo", "hi")).alias("date"))
    items = days.select("date", F.explode(F.array(*map(F.lit, ("early", "late", "never", "once")))).alias("item"))
    day = F.datediff("date", F.lit(FIRST))
    units = F.when(F.col("item") == "early", day % 7 + F.month("date")).when(F.col("item") == "late", F.when(day > 250, day % 5)).when(F.col("item") == "once", F.when(day == 100, 9))
    return items.withColumn("quantity", F.coalesce(units, F.lit(0)).cast("bigint")).cache()


def profiles(df):
    return {r["item"]: (r["level"], list(r["weekly"]), list(r["monthly"]), r["dispersion"]) for r in df.collect()}


@pytest.mark.parametrize("start", [FIRST, dt.date(2020, 4, 1), dt.date(2020, 9, 1), dt.date(2021, 3, 1)])
def test_cells_give_the_profiles_of_the_full_run(grid, start):
    cells = state.month_cells(grid, ["item"])
    full = calibrate.calibrate_profiles(grid, ["item"], LAST, None, start=start)
    assert profiles(state.profiles_from_cells(cells, ["item"], start)) == profiles(full)


def test_a_month_is_added_without_reading_the_others(spark, grid, tmp_path):
    root = str(tmp_path / "cells")
    for low, high in ((FIRST, dt.date(2021, 4, 30)), (dt.date(2021, 5, 1), dt.date(2021, 5, 31)), (dt.date(2021, 6, 1), LAST)):
        added = state.add_months(grid.where((F.col("date") >= F.lit(low)) & (F.col("date") <= F.lit(high))), root, ["item"])
    assert added.number == 3 and len(added.parts) == 18
    first = {p.value: p.folder for p in versions.version(spark, root, 1).parts}
    assert {p.value: p.folder for p in added.parts if p.value in first} == first
    stored = versions.read_verified(spark, root)
    assert profiles(state.profiles_from_cells(stored, ["item"], FIRST)) == profiles(calibrate.calibrate_profiles(grid, ["item"], LAST, None, start=FIRST))
    state.add_months(grid.where("date >= '2021-06-01'").withColumn("quantity", F.col("quantity") * 2), root, ["item"])  # a corrected month
    corrected = grid.withColumn("quantity", F.when(F.col("date") >= "2021-06-01", F.col("quantity") * 2).otherwise(F.col("quantity")))
    assert profiles(state.profiles_from_cells(versions.read(spark, root), ["item"], FIRST)) == profiles(calibrate.calibrate_profiles(corrected, ["item"], LAST, None, start=FIRST))


def test_accuracy_sums_add_up(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice("xyz"), rng.random() * 10, rng.choice([None, 0.0, rng.random() * 10])) for _ in range(200)]
    df = spark.createDataFrame(rows, "model string, item string, forecast double, actual double")
    sums = state.accuracy_sums(df.limit(0), "model", "item").unionByName(state.accuracy_sums(df.where("item = 'x'"), "model", "item")).unionByName(state.accuracy_sums(df.where("item <> 'x'"), "model", "item"))
    for by in ((), ("model",), ("model", "item")):
        want = {tuple(r[b] for b in by): r for r in fc.forecast_accuracy(df, *by).collect()}
        for r in state.merged_accuracy(sums, *by).collect():
            for m in ("forecast_rows_evaluated", "mae", "rmse", "wape", "bias"):
                assert r[m] == pytest.approx(want[tuple(r[b] for b in by)][m])
    assert state.merged_accuracy(sums.limit(0)).first()["forecast_rows_evaluated"] == 0


EDGES = "dataset_id string, version string, input_id string, input_version string, old boolean"


def test_ancestors_depth_and_drift(spark):
    rows = [("c", "1", "b", "1", False), ("b", "1", "a", "1", True), ("c", "1", "a", "1", False), ("d", "1", "c", "1", False), ("d", "1", "e", "2", None), ("d", "1", "e", "2", False)]
    got = {tuple(r)[:1] + tuple(r)[2:3]: (r["depth"], r["drifted"]) for r in lineage.ancestors(spark.createDataFrame(rows, EDGES), F.col("old")).collect()}
    assert got == {("b", "a"): (1, True), ("c", "b"): (1, False), ("c", "a"): (1, True), ("d", "c"): (1, False), ("d", "e"): (1, False), ("d", "b"): (2, False), ("d", "a"): (2, True)}
    reach = {r["dataset_id"]: (r["dependants"], r["furthest"]) for r in lineage.impact(spark.createDataFrame(rows, EDGES)).collect()}
    assert reach == {"a": (3, 2), "b": (2, 2), "c": (1, 1), "e": (1, 1)}
    assert lineage.ancestors(spark.createDataFrame([], EDGES)).collect() == []


def test_a_cycle_is_reported(spark):
    rows = [("a", "1", "b", "1", None), ("b", "1", "c", "1", None), ("c", "1", "a", "1", None), ("x", "1", "a", "1", None)]
    with pytest.raises(lineage.LineageCycle, match="'a', '1'|'b', '1'|'c', '1'"):
        lineage.ancestors(spark.createDataFrame(rows, EDGES))


def test_ranks_within_groups_split_hot_groups(spark):
    rng = random.Random(9)
    rows = [(rng.choice("hhhhhhab"), rng.randrange(20), k) for k in range(2000)] + [(None, 1, 5000), (None, None, 5001)]
    ranked = X.ranks_within(spark.createDataFrame(rows, "g string, v int, k int").repartition(5), "g", [F.col("v"), F.col("k")])
    want = {}
    for g in "hab":
        for place, (_, v, k) in enumerate(sorted(r for r in rows if r[0] == g), 1):
            want[k] = place
    got = {r["k"]: r["rank"] for r in ranked.collect()}
    assert all(got[k] == place for k, place in want.items())


def test_rank_correlation_keeps_marginals_nulls_and_ties(spark):
    from stockweave.plans import synth

    rng = random.Random(2)
    rows = [(k, rng.choice([None, 1, 2, 3, 2**60 + k]), rng.random(), f"t{k}") for k in range(400)]
    df = spark.createDataFrame(rows, "key int, a bigint, b double, other string")
    out = synth.rank_correlate(df, ["key"], ["a", "b"], [[1.0, 0.9], [0.9, 1.0]], 3)
    got = out.collect()
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    assert sorted((r["a"] for r in got), key=lambda v: (v is not None, v)) == sorted((r[1] for r in rows), key=lambda v: (v is not None, v))
    assert sorted(r["b"] for r in got) == sorted(r[2] for r in rows) and {(r["key"], r["other"]) for r in got} == {(r[0], r[3]) for r in rows}
