"""Run and variant comparisons over metric rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockweave.functions.numeric import ratio_or_null
from stockweave.plans.kpis import KPI_UNITS


def metrics_pivot(rows: DataFrame, by: Sequence[str] = ("variant",), metrics: Sequence[str] = tuple(KPI_UNITS)) -> DataFrame:
    """Metric rows to one row per group with a column per metric (the metric list is known up front)."""
    total = rows.where(F.col("scope") == "total") if "scope" in rows.columns else rows
    return total.groupBy(*by).pivot("metric_id", list(metrics)).agg(F.first("value"))


def run_comparison(rows: DataFrame, runs: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Chosen runs side by side: (run, variant) by metric."""
    return metrics_pivot(rows.where(F.col("run_id").isin(*runs)), ("run_id", "variant"), metrics)


def variant_run_table(rows: DataFrame, metric: str, runs: Sequence[str]) -> DataFrame:
    """One metric as a variant by run table."""
    chosen = rows.where((F.col("metric_id") == metric) & F.col("run_id").isin(*runs))
    return chosen.groupBy("variant").pivot("run_id", list(runs)).agg(F.first("value"))


def metric_delta(rows: DataFrame, base_run: str) -> DataFrame:
    """Each metric of each run against the base run: difference and ratio (null on a zero base)."""
    same = W.partitionBy("variant", "metric_id")  # one row per run
    is_base = F.col("run_id") == base_run
    joined = rows.select(
        "run_id", "variant", "metric_id", "value", F.max(F.when(is_base, F.col("value"))).over(same).alias("base_value"), F.max(is_base).over(same).alias("_known")
    ).where(~is_base & F.col("_known")).drop("_known")
    return joined.withColumns({"delta": F.col("value") - F.col("base_value"), "ratio": ratio_or_null(F.col("value"), F.col("base_value"))})


def policy_scorecard(kpis: DataFrame, variant: str = "variant") -> DataFrame:
    """KPI columns per variant with the rank of each variant by total cost."""
    order = W.partitionBy(F.lit(1)).orderBy("total_cost", variant)  # one row per variant
    return kpis.withColumn("cost_rank", F.row_number().over(order).cast("bigint"))


def scenario_ratio(demand: DataFrame, base: str, start_day: int, duration_days: int) -> DataFrame:
    """Demand of each scenario relative to the base: overall, inside and outside a day window."""
    inside = (F.col("day_index") >= start_day) & (F.col("day_index") < start_day + duration_days)
    sums = demand.groupBy("scenario_id").agg(
        F.sum("quantity").alias("total"), F.sum(F.when(inside, F.col("quantity"))).alias("inside"), F.sum(F.when(~inside, F.col("quantity"))).alias("outside")
    )
    scenarios = W.partitionBy(F.lit(1))  # one row per scenario
    is_base = F.col("scenario_id") == base
    parts = ("total", "inside", "outside")
    known = sums.withColumns({**{f"_{c}": F.max(F.when(is_base, F.col(c))).over(scenarios) for c in parts}, "_known": F.max(is_base).over(scenarios)})
    joined = known.where("_known")
    ratios = {f"{c}_ratio": ratio_or_null(F.col(c), F.col(f"_{c}")) for c in ("total", "inside", "outside")}
    return joined.withColumns(ratios).select("scenario_id", "total", *ratios)
