"""Operational tables (warehouses, suppliers, stock, policies) around a retail demand history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.numeric import as_column, round_half_even, round_half_even_int
from stockweave.functions.random import seeded_uniform, table_seed, uniform_between
from stockweave.operators.aggregates import mean_daily_demand, mean_price, store_demand
from stockweave.operators.joins import many_to_one
from stockweave.operators.windows import distributed_rank, sequence_ids
from stockweave.plans import synth


@dataclass(frozen=True)
class OperationsConfig:
    """Assumptions of the operational environment."""

    # Default assumptions.
    supplier_count: int = 5
    order_cost_range: tuple[float, float] = (20.0, 60.0)
    min_order_qty_choices: tuple[int, ...] = (0, 6, 12)
    lead_time_gamma_shape: float = 9.0
    lead_time_gamma_scale: float = 0.7
    lead_time_std_range: tuple[float, float] = (0.5, 2.0)
    lead_time_mean_std_correlation: float = 0.5
    on_time_probability_range: tuple[float, float] = (0.85, 0.99)
    cost_ratio: float = 0.7
    case_pack_choices: tuple[int, ...] = (6, 12, 24)
    holding_cost_rate_annual: float = 0.25
    capacity_days_of_demand: float = 60.0
    demand_window_days: int = 365
    review_period_days: int = 1
    order_cycle_days: int = 14
    target_service_level: float = 0.95


def build_suppliers(reference: DataFrame, key: str, seed: int, cfg: OperationsConfig, keep_key: bool = False) -> DataFrame:
    """Supplier ids with order cost and minimum order quantity, one per reference row."""
    rules = {
        "supplier_id": synth.copied(key) if keep_key else synth.numbered(prefix="SUP", width=3),
        "order_cost": synth.uniform(*cfg.order_cost_range, decimals=2),
        "min_order_qty": synth.choice(cfg.min_order_qty_choices),
    }
    suppliers = synth.generate_table(reference, rules, table_seed(seed, "supplier"), [key])
    return suppliers.withColumn("min_order_qty", F.col("min_order_qty").cast("bigint"))


def build_lead_times(suppliers: DataFrame, seed: int, cfg: OperationsConfig) -> DataFrame:
    """Gamma means, uniform spreads with a rank correlation, uniform punctuality."""
    key, own = [F.col("supplier_id")], table_seed(seed, "supplier_lead_time")
    drawn = suppliers.select(
        "supplier_id",
        synth.gamma(own, "lead_time_mean_days", key, cfg.lead_time_gamma_shape, cfg.lead_time_gamma_scale).alias("lead_time_mean_days"),
        uniform_between(seeded_uniform(own, "lead_time_std_days", *key), *cfg.lead_time_std_range).alias("lead_time_std_days"),
        uniform_between(seeded_uniform(own, "on_time_probability", *key), *cfg.on_time_probability_range, decimals=3).alias("on_time_probability"),
    )
    r = cfg.lead_time_mean_std_correlation
    paired = synth.rank_correlate(drawn, ["supplier_id"], ["lead_time_mean_days", "lead_time_std_days"], [[1.0, r], [r, 1.0]], own)
    mean, _ = synth.clip_and_round(F.col("lead_time_mean_days"), low=max(2.0, cfg.lead_time_std_range[1]), decimals=2)
    return paired.withColumns({"lead_time_mean_days": mean, "lead_time_std_days": round_half_even(F.col("lead_time_std_days"), 2)})


def assign_suppliers(prices: DataFrame, suppliers: DataFrame, seed: int, cfg: OperationsConfig) -> DataFrame:
    """Supplier, unit cost and case pack per product. Suppliers are numbered and met by an equi-join."""
    own = table_seed(seed, "product_supplier")
    numbered = distributed_rank(suppliers.select("supplier_id"), [F.col("supplier_id")], "_number")
    count = suppliers.agg(F.count(F.lit(1))).scalar()
    pick = F.floor(seeded_uniform(own, "supplier_id", F.col("product_id")) * count).cast("bigint") + 1
    pack = synth.built_column("case_pack", synth.choice(cfg.case_pack_choices), own, [F.col("product_id")])
    priced = prices.select(
        "product_id", round_half_even(F.col("avg_unit_price") * F.lit(cfg.cost_ratio), 2).alias("unit_cost"), pack.cast("bigint").alias("case_pack"), pick.alias("_number")
    )
    return priced.join(numbered, "_number").select("product_id", "supplier_id", "unit_cost", "case_pack")


def stock_target(mean_demand: Column, lead: Column, cycle_days: object) -> Column:
    """mean demand * (lead + cycle / 2), six decimals."""
    return round_half_even(mean_demand * (lead + as_column(cycle_days).cast("double") / F.lit(2.0)), 6)


def build_operations(sales: DataFrame, price: DataFrame, seed: int, end: object, suppliers: DataFrame, lead_times: DataFrame,
                     cfg: OperationsConfig | None = None) -> dict[str, DataFrame]:
    """All operational and derived tables from sales, prices, suppliers and their lead times."""
    cfg = cfg or OperationsConfig()
    demand = mean_daily_demand(sales, cfg.demand_window_days, end)
    product_price, stores = mean_price(price), store_demand(demand)
    numbered = sequence_ids(stores, [F.col("store_id")], "warehouse_id", prefix="WH", width=2)
    warehouse = numbered.select(
        "warehouse_id", "store_id", round_half_even_int(F.col("mean_daily_demand") * F.lit(cfg.capacity_days_of_demand) + F.lit(1.0)).alias("capacity_units"),
        F.lit(cfg.holding_cost_rate_annual).alias("holding_cost_rate_annual"),
    )
    product_supplier = assign_suppliers(product_price, suppliers, seed, cfg)
    joined = many_to_one(demand, warehouse.select("warehouse_id", "store_id"), ["store_id"])
    joined = many_to_one(joined, product_supplier.select("product_id", "supplier_id"), ["product_id"])
    joined = many_to_one(joined, lead_times.select("supplier_id", "lead_time_mean_days"), ["supplier_id"])
    planning = joined.withColumn("initial_stock_target", stock_target(F.col("mean_daily_demand"), F.col("lead_time_mean_days"), cfg.order_cycle_days)).drop("supplier_id")
    item = planning.select("product_id", "warehouse_id", "initial_stock_target")
    inventory = item.select("product_id", "warehouse_id", round_half_even_int(F.col("initial_stock_target")).alias("on_hand_units"), F.lit(0).cast("bigint").alias("on_order_units"))
    policy = item.select(
        "product_id", "warehouse_id", F.lit(cfg.review_period_days).cast("bigint").alias("review_period_days"),
        F.lit(cfg.order_cycle_days).cast("bigint").alias("order_cycle_days"), F.lit(cfg.target_service_level).alias("target_service_level"),
    )
    return {
        "product_price": product_price,
        "store_demand": stores,
        "warehouse": warehouse,
        "supplier": suppliers,
        "supplier_lead_time": lead_times,
        "product_supplier": product_supplier,
        "planning_input": planning,
        "initial_inventory": inventory,
        "replenishment_policy": policy,
    }


def generate_operations(spark, sales: DataFrame, price: DataFrame, seed: int, end: object, cfg: OperationsConfig | None = None) -> dict[str, DataFrame]:
    """As ``build_operations`` with generated suppliers and lead times."""
    cfg = cfg or OperationsConfig()
    suppliers = build_suppliers(spark.range(cfg.supplier_count).withColumnRenamed("id", "n"), "n", seed, cfg)
    return build_operations(sales, price, seed, end, suppliers, build_lead_times(suppliers, seed, cfg), cfg)


def hybrid_tables(retail: dict[str, DataFrame], operations: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Retail and operations tables together; shared names are an error."""
    overlap = sorted(set(retail) & set(operations))
    if overlap:
        raise ValueError(f"table names overlap: {overlap}")
    return {**retail, **operations}
