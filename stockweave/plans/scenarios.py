"""Scenario parameters as tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.plans.calibrate import EFFECT_NAMES

# The built-in scenarios and the parameter name of the demand level effect.
SCENARIOS: dict[str, dict[str, float]] = {
    "baseline": {},
    "high_demand": {"demand_multiplier": 1.30, "seasonality_multiplier": 1.20},
    "demand_shock": {"shock_multiplier": 2.50, "shock_start_day": 28, "shock_duration_days": 14},
    "supply_disruption": {"lead_time_delta": 7, "disruption_start_day": 28, "disruption_duration_days": 42, "supply_capacity_factor": 0.50},
}
DEMAND_MAPPING = {"level_multiplier": "demand_multiplier"}


def parameter_table(spark: SparkSession, scenarios: Mapping[str, Mapping[str, float]] = SCENARIOS) -> DataFrame:
    """(scenario_id, parameter, value) rows."""
    rows = [(s, p, float(v)) for s, parameters in scenarios.items() for p, v in parameters.items()]
    return spark.createDataFrame(rows, "scenario_id string, parameter string, value double")


def effect_mapping(spark: SparkSession, mapping: Mapping[str, str] = DEMAND_MAPPING) -> DataFrame:
    """(effect, parameter) rows: the parameter that feeds each effect."""
    return spark.createDataFrame([(e, mapping.get(e, e)) for e in EFFECT_NAMES], "effect string, parameter string")


def scenario_effects(parameters: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each scenario parameter with the effect it feeds, or ``unused``."""
    joined = parameters.join(mapping, "parameter", "left")
    status = F.when(F.col("effect").isNull(), "unused").otherwise("applied")
    return joined.select("scenario_id", "parameter", "value", "effect", status.alias("status"))


def unused_parameters(parameters: DataFrame, mapping: DataFrame) -> DataFrame:
    return parameters.join(mapping, "parameter", "left_anti").select("scenario_id", "parameter")


def ignored_noise(parameters: DataFrame, distribution: str) -> DataFrame:
    """Scenarios whose noise scale has no effect because counts follow the Poisson law."""
    relevant = (F.col("parameter") == "noise_scale") & (F.col("value") != 1.0) & F.lit(distribution == "poisson")
    return parameters.where(relevant).select("scenario_id", F.lit("noise_scale only applies to the negative binomial distribution").alias("warning"))


def scenario_report(demand: DataFrame, parameters: DataFrame, mapping: DataFrame, distribution: str = "negative_binomial") -> DataFrame:
    """One row per scenario of flagged ``scenario_demand``: rows, units, clipped and event days, unused parameters, warning.

    Scenarios are few; each has one row before the joins.
    """
    totals = demand.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("demand_rows"), F.sum("quantity").alias("units"), F.count_if("season_clipped").alias("clipped_rows"), F.count_if("on_event").alias("event_rows"),
    )
    unused = unused_parameters(parameters, mapping).groupBy("scenario_id").agg(F.array_join(F.array_sort(F.collect_list("parameter")), ",").alias("unused"))
    joined = totals.join(unused, "scenario_id", "left").join(ignored_noise(parameters, distribution), "scenario_id", "left")
    return joined.withColumns({"unused": F.coalesce("unused", F.lit("")), "warning": F.coalesce("warning", F.lit(""))})
