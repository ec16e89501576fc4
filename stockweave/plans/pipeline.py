"""One scenario from retail tables to forecasts, replenishment levels and accuracy.

Every stage is a lazy table. Stages that later ones read several times are stored in the scenario's
folder first, so that they are computed once and survive lost executors.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.functions.random import table_seed
from stockweave.operators.aggregates import active_history_mean
from stockweave.operators.spine import observed_grid
from stockweave.plans import forecast as fc
from stockweave.plans import operations, planning, synth
from stockweave.plans.calibrate import calibrate_profiles, effects_from
from stockweave.plans.scenarios import DEMAND_MAPPING, SCENARIOS

ENTITIES = ("product_id", "store_id")


@dataclass(frozen=True)
class ScenarioRun:
    """Settings of a run; the horizon starts the day after the last sale."""

    scenario_id: str = "baseline"
    seed: int = 20260927
    horizon_days: int = 91
    warm_up_days: int = 56
    forecast_model: str = "seasonal_naive"
    overrides: Mapping[str, float] = field(default_factory=dict)
    operations: operations.OperationsConfig = operations.OperationsConfig()

    def parameters(self) -> dict[str, float]:
        if self.scenario_id not in SCENARIOS:
            raise ValueError(f"unknown scenario {self.scenario_id!r}; known: {sorted(SCENARIOS)}")
        return {**SCENARIOS[self.scenario_id], **self.overrides}


def _stored(df: DataFrame, root: str, name: str) -> DataFrame:
    path = f"{root}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_scenario(retail: Mapping[str, DataFrame], run: ScenarioRun, root: str) -> dict[str, DataFrame]:
    """All tables of a run, stored below ``root`` (a new folder the executors share)."""
    spark = retail["sales"].sparkSession
    sales = _stored(retail["sales"].select("date", *ENTITIES, "quantity"), root, "sales")
    limits = sales.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()  # one row
    first, last = limits["lo"], limits["hi"]
    start, end = last + dt.timedelta(days=1), last + dt.timedelta(days=run.horizon_days)
    tables = operations.generate_operations(spark, sales, retail["price"], run.seed, F.lit(last), run.operations)
    tables = {name: _stored(df, root, name) for name, df in tables.items()}

    effects, applied, unused = effects_from(run.parameters(), DEMAND_MAPPING)
    profiles = calibrate_profiles(sales, ENTITIES, F.lit(last))
    demand = synth.scenario_demand(profiles, {run.scenario_id: effects}, F.lit(start), run.horizon_days, table_seed(run.seed, "demand"), ENTITIES)
    demand = _stored(demand.drop("day_index"), root, "synthetic_demand")
    timeline = _stored(synth.union_timeline(sales, demand, ENTITIES), root, "demand_timeline")

    # Origins run weekly from the warm-up to the horizon end; each sees the days before it only.
    spec = fc.ForecastSpec(ENTITIES)
    bounds = spark.createDataFrame([(first, end)], "lo date, hi date")
    grid = observed_grid(timeline, "date", ENTITIES, "quantity", bounds).drop("observed")
    origins = fc.OriginRange(F.lit(start - dt.timedelta(days=run.warm_up_days)), F.lit(end), F.lit(first), F.lit(end))
    makers = {
        "seasonal_naive": lambda: fc.seasonal_naive_forecast(grid, spec, origins),
        "moving_average": lambda: fc.moving_average_forecast(grid, spec, origins),
        "learned": lambda: fc.learned_forecast(grid, spec, bounds, origins),
    }
    if run.forecast_model not in makers:
        raise ValueError(f"unknown forecast model {run.forecast_model!r}; known: {sorted(makers)}")
    forecast = _stored(fc.attach_actuals(makers[run.forecast_model](), grid, spec), root, "forecast")

    item = tables["planning_input"].join(tables["replenishment_policy"], ["product_id", "warehouse_id"])
    parameters = run.parameters()
    planned = item.withColumn("lead_time_mean_days", planning.planner_lead_time(F.col("lead_time_mean_days"), parameters.get("lead_time_delta", 0), bool(parameters.get("planner_aware", False))))
    keyed = planned.select(*ENTITIES, "warehouse_id", "lead_time_mean_days", "order_cycle_days", "target_service_level")
    cycle = run.operations.order_cycle_days
    first_day = keyed.withColumn("day", F.lit(start))
    reviews = keyed.withColumn("day", F.explode(F.array(*[F.lit(start + dt.timedelta(days=d)) for d in range(0, run.horizon_days, cycle)])))
    levels = {
        "reorder_point": planning.reorder_point_levels(active_history_mean(sales, 365, ENTITIES), keyed, ENTITIES),
        "safety_stock": planning.safety_stock_levels(first_day, forecast, ENTITIES),
        "order_up_to": planning.order_up_to_levels(reviews, forecast, ENTITIES),
    }
    return {
        **tables,
        "synthetic_demand": demand,
        "demand_timeline": timeline,
        "forecast": forecast,
        "forecast_accuracy": fc.forecast_accuracy(forecast.where(F.col("origin_date") >= F.lit(start))),
        **{f"levels_{name}": df for name, df in levels.items()},
        "scenario_parameters": spark.createDataFrame([(p, "applied") for p in applied] + [(p, "unused") for p in unused], "parameter string, status string"),
    }
