"""Queries of section N (table synthesis and scenario demand)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions.numeric import stable6
from stockweave.plans import calibrate, operations, report, scenarios, synth
from stockweave.queries import inputs as I
from stockweave.queries.aggregates import calibrated
from stockweave.queries.inputs import ENTITIES
from stockweave.queries.joins import mean_daily
from stockweave.queries.registry import query
from stockweave.queries.reshape import expected_rows, horizon_start
from stockweave.queries.sqlparts import define, even, normal, r6, uniform, with_ctes
from stockweave.functions.random import table_seed
from stockweave.sources.drivertables import SEED


def parts(t):
    return t.raw("part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


def generate(t, rules):
    """Rules over the part table, the key kept for comparison."""
    return synth.generate_table(parts(t), {"p_partkey": synth.copied("p_partkey"), **rules}, SEED, ["p_partkey"])


@query("gen_constant", "SELECT p_partkey, CAST(25 AS BIGINT) AS order_cost, 'EUR' AS currency FROM part")
def gen_constant(t):
    return generate(t, {"order_cost": synth.constant(25), "currency": synth.constant("EUR")})


def choice_sql(column: str, values: list[str], bounds: list[float]) -> str:
    u = uniform(column, "p_partkey")
    whens = " ".join(f"WHEN {u} < {b!r}::DOUBLE THEN {v}" for v, b in zip(values[:-1], bounds[:-1]))
    return f"CASE {whens} ELSE {values[-1]} END"


@query("gen_choice", f"SELECT p_partkey, {choice_sql('tier', ['chr(65)', 'chr(66)'], [0.8, 1.0])} AS tier, {choice_sql('moq', ['0', '6', '12'], [1 / 3, 2 / 3, 1.0])} AS moq FROM part")
def gen_choice(t):
    return generate(t, {"tier": synth.choice(("A", "B"), (0.8, 0.2)), "moq": synth.choice((0, 6, 12))})


@query("gen_uniform", f"SELECT p_partkey, {even('20.0 + ' + uniform('order_cost', 'p_partkey') + ' * 40.0', 2)} AS order_cost, CAST(floor({uniform('capacity', 'p_partkey')} * 11.0) + 10 AS BIGINT) AS capacity FROM part")
def gen_uniform(t):
    return generate(t, {"order_cost": synth.uniform(20.0, 60.0, decimals=2), "capacity": synth.uniform(10, 20, integer=True)})


@query("gen_linear", f"SELECT p_partkey, {even('p_retailprice * 0.7 + 0.0', 2)} AS unit_cost, {even(even('p_retailprice * 0.7 + 0.0', 2) + ' * 1.5 + 2.0', 2)} AS rush_cost, CAST({even('p_size * 60.0 + 1.0')} AS BIGINT) AS capacity FROM part")
def gen_linear(t):
    return generate(t, {
        "unit_cost": synth.linear("p_retailprice", scale=0.7, decimals=2),
        "rush_cost": synth.linear("unit_cost", scale=1.5, offset=2.0, decimals=2),
        "capacity": synth.linear("p_size", scale=60.0, offset=1.0, integer=True),
    })


@query("gen_lookup", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'budget' WHEN 'PROMO' THEN 'offer' ELSE 'regular' END AS label, CASE CAST(p_size AS VARCHAR) WHEN '1' THEN 'unit' END AS size_label FROM part")
def gen_lookup(t):
    return generate(t, {"label": synth.lookup("p_type", {"ECONOMY": "budget", "PROMO": "offer"}, "regular"), "size_label": synth.lookup("p_size", {"1": "unit"})})


@query("gen_reference_column", "SELECT p_partkey, p_brand AS brand, p_type AS kind FROM part")
def gen_reference_column(t):
    return generate(t, {"brand": synth.copied("p_brand"), "kind": synth.copied("p_type")})


@query("gen_sequence", "SELECT p_partkey, 'SKU' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS sku, r + 99 AS n FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part)")
def gen_sequence(t):
    return generate(t, {"sku": synth.numbered(prefix="SKU"), "n": synth.numbered(start=100, as_int=True)})


def key_of(t):
    return [F.col("p_partkey")]


@query("gen_normal", f"SELECT p_partkey, {r6('100.0 + 15.0 * ' + normal('score', 'p_partkey'))} AS score FROM part")
def gen_normal(t):
    return t.raw("part").select("p_partkey", stable6(synth.normal(SEED, "score", key_of(t), 100.0, 15.0)).alias("score"))


@query("gen_lognormal", f"SELECT p_partkey, {r6('exp(0.5 + 0.25 * ' + normal('size', 'p_partkey') + ')')} AS size_factor FROM part")
def gen_lognormal(t):
    return t.raw("part").select("p_partkey", stable6(synth.lognormal(SEED, "size", key_of(t), 0.5, 0.25)).alias("size_factor"))


_NOISE, _SIZE = f"(10.0 + 4.0 * {normal('noise', 'p_partkey')})", f"exp(1.0 + 0.5 * {normal('size', 'p_partkey')})"


@query("gen_declared_laws", f"""SELECT p_partkey, {even(f'least(greatest({_NOISE}, 5), 15)', 2)} AS noise, {_NOISE} < 5 OR {_NOISE} > 15 AS noise_clipped,
    {even(f'least({_SIZE}, 6)', 3)} AS size, {_SIZE} > 6 AS size_clipped FROM part""")
def gen_declared_laws(t):
    rules = {"noise": synth.drawn("normal", 10.0, 4.0, low=5.0, high=15.0, decimals=2), "size": synth.drawn("lognormal", 1.0, 0.5, high=6.0, decimals=3)}
    return synth.generate_table(parts(t), {"p_partkey": synth.copied("p_partkey"), **rules}, SEED, ["p_partkey"], flags=True)


@query("gen_categorical", f"SELECT p_partkey, {choice_sql('grade', ['chr(120)', 'chr(121)', 'chr(122)'], [0.5, 0.8, 1.0])} AS grade FROM part")
def gen_categorical(t):
    return generate(t, {"grade": synth.choice(("x", "y", "z"), (5, 3, 2))})


@query(
    "clip_and_round",
    f"""SELECT p_type, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (v < 80 OR v > 120) AS BIGINT) AS clipped, CAST(sum({even('least(greatest(v, 80), 120)')}) AS BIGINT) AS total,
        min({even('least(greatest(v, 80), 120)', 2)}) AS low, max({even('least(greatest(v, 80), 120)', 2)}) AS high FROM (SELECT p_type, 100.0 + 15.0 * {normal('score', 'p_partkey')} AS v FROM part) GROUP BY ALL""",
)
def clip_and_round(t):
    raw = synth.normal(SEED, "score", key_of(t), 100.0, 15.0)
    whole, outside = synth.clip_and_round(F.col("v"), 80.0, 120.0, integer=True)
    exact, _ = synth.clip_and_round(F.col("v"), 80.0, 120.0, decimals=2)
    rows = t.raw("part").select("p_type", raw.alias("v")).select("p_type", whole.alias("whole"), outside.alias("outside"), exact.alias("exact"))
    return rows.groupBy("p_type").agg(F.count(F.lit(1)).alias("rows"), F.count_if("outside").alias("clipped"), F.sum("whole").alias("total"), F.min("exact").alias("low"), F.max("exact").alias("high"))


_RHO, _REST = 0.6, repr((1 - 0.6**2) ** 0.5)


@query(
    "rank_correlate",
    f"""WITH s AS (SELECT p_partkey, p_retailprice, p_size, {normal('score.0', 'p_partkey')} AS z0, {normal('score.1', 'p_partkey')} AS z1 FROM part),
places AS (SELECT p_partkey, row_number() OVER (ORDER BY z0, p_partkey) AS r0, row_number() OVER (ORDER BY {_RHO} * z0 + {_REST} * z1, p_partkey) AS r1 FROM s),
v0 AS (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS r FROM s), v1 AS (SELECT p_size, row_number() OVER (ORDER BY p_size, p_partkey) AS r FROM s)
SELECT p_partkey, v0.p_retailprice, v1.p_size FROM places JOIN v0 ON v0.r = r0 JOIN v1 ON v1.r = r1""",
)
def rank_correlate(t):
    table = t.raw("part").select("p_partkey", "p_retailprice", "p_size")
    return synth.rank_correlate(table, ["p_partkey"], ["p_retailprice", "p_size"], [[1.0, _RHO], [_RHO, 1.0]], SEED)


@query("expected_demand", with_ctes("expected", f"SELECT product_id, store_id, date, day_index, {r6('rate')} AS rate, quantity AS expected, season_clipped FROM expected WHERE scenario_id = 'high_demand'"))
def expected_demand(t):
    rows = expected_rows(t, calibrate.Effects(level_multiplier=1.3, seasonality_multiplier=1.2))
    return rows.select(*ENTITIES, "date", "day_index", stable6(F.col("rate")).alias("rate"), "expected", "season_clipped")


@query("sample_demand")
def sample_demand(t):
    return synth.sample_demand(expected_rows(t), SEED, [*ENTITIES, "date"]).select(*ENTITIES, "date", stable6(F.col("rate")).alias("rate"), "quantity")


@query("gen_gamma")
def gen_gamma(t):
    return t.raw("part").select("p_partkey", synth.gamma(SEED, "lead", key_of(t), 9.0, 0.7).alias("lead_time"))


@query("gen_poisson")
def gen_poisson(t):
    return t.raw("part").select("p_partkey", synth.poisson(SEED, "arrivals", key_of(t), 4.0).alias("arrivals"))


@query("gen_negative_binomial")
def gen_negative_binomial(t):
    return t.raw("part").select("p_partkey", synth.negative_binomial(SEED, "orders", key_of(t), 4.0, 2.0).alias("orders"))


_PARAMETERS = """(VALUES ('high_demand', 'demand_multiplier', 1.3::DOUBLE), ('high_demand', 'seasonality_multiplier', 1.2::DOUBLE), ('demand_shock', 'shock_multiplier', 2.5::DOUBLE),
('demand_shock', 'shock_start_day', 28.0::DOUBLE), ('demand_shock', 'shock_duration_days', 14.0::DOUBLE), ('supply_disruption', 'lead_time_delta', 7.0::DOUBLE),
('supply_disruption', 'disruption_start_day', 28.0::DOUBLE), ('supply_disruption', 'disruption_duration_days', 42.0::DOUBLE), ('supply_disruption', 'supply_capacity_factor', 0.5::DOUBLE)) p(scenario_id, parameter, value)"""
_MAPPING = """(VALUES ('level_multiplier', 'demand_multiplier'), ('seasonality_multiplier', 'seasonality_multiplier'), ('noise_scale', 'noise_scale'), ('shock_multiplier', 'shock_multiplier'),
('shock_start_day', 'shock_start_day'), ('shock_duration_days', 'shock_duration_days')) m(effect, parameter)"""


@query(
    "scenario_effects",
    with_ctes("profiles", f"""SELECT p.scenario_id, p.parameter, p.value, m.effect, CASE WHEN m.effect IS NULL THEN 'unused' ELSE 'applied' END AS status,
    CAST(CASE WHEN m.effect IS NULL THEN 0 ELSE (SELECT count(*) FROM profiles WHERE level > 0) END AS BIGINT) AS series_affected FROM {_PARAMETERS} LEFT JOIN {_MAPPING} ON m.parameter = p.parameter"""),
)
def scenario_effects(t):
    report_rows = scenarios.scenario_effects(scenarios.parameter_table(t.spark), scenarios.effect_mapping(t.spark))
    series = calibrated(t).agg(F.count_if(F.col("level") > 0)).scalar()
    return report_rows.withColumn("series_affected", F.when(F.col("status") == "applied", series).otherwise(F.lit(0)).cast("bigint"))


def noise_free(t):
    effects = {name: calibrate.effects_from({**p, "noise_scale": 0.0}, scenarios.DEMAND_MAPPING)[0] for name, p in scenarios.SCENARIOS.items()}
    return synth.scenario_demand(calibrated(t), effects, horizon_start(t), 91, SEED, ENTITIES)


@query("scenario_demand", with_ctes("expected", "SELECT date, product_id, store_id, quantity, scenario_id, day_index FROM expected"))
def scenario_demand(t):
    return noise_free(t)


#: The built-in scenarios and one that only turns the noise down, which counts without dispersion do not know.
REPORTED = {**scenarios.SCENARIOS, "calm": {"noise_scale": 0.5}}
EVENT_DAYS = "strftime(date, '%m-%d') IN ('01-20', '05-01', '06-15', '08-15', '10-03')"


@query(
    "scenario_report",
    with_ctes("expected", f""", rows AS (SELECT * FROM expected UNION ALL SELECT 'calm', * EXCLUDE (scenario_id) FROM expected WHERE scenario_id = 'baseline'),
flagged AS (SELECT scenario_id, season_clipped, {EVENT_DAYS} AS on_event, CAST(round_even(rate * CASE WHEN {EVENT_DAYS} THEN 1.5 ELSE 1.0 END, 0) AS BIGINT) AS quantity FROM rows)
SELECT scenario_id, CAST(count(*) AS BIGINT) AS demand_rows, CAST(sum(quantity) AS BIGINT) AS units, CAST(count(*) FILTER (season_clipped) AS BIGINT) AS clipped_rows,
       CAST(count(*) FILTER (on_event) AS BIGINT) AS event_rows,
       CASE scenario_id WHEN 'supply_disruption' THEN 'disruption_duration_days,disruption_start_day,lead_time_delta,supply_capacity_factor' ELSE '' END AS unused,
       CASE scenario_id WHEN 'calm' THEN 'noise_scale only applies to the negative binomial distribution' ELSE '' END AS warning
FROM flagged GROUP BY scenario_id"""),
)
def scenario_report(t):
    """Expected demand of every scenario with its event days, and what of its parameters had no effect under the Poisson law."""
    from stockweave.sources import retail

    effects = {name: calibrate.effects_from({**p, "noise_scale": 0.0}, scenarios.DEMAND_MAPPING)[0] for name, p in REPORTED.items()}
    start = horizon_start(t)
    days = t.ship_bounds.select(F.explode(F.sequence(start, F.date_add(start, 90))).alias("date"))
    demand = synth.scenario_demand(calibrated(t), effects, start, 91, SEED, ENTITIES, events=retail.event_calendar(days), event_multiplier=1.5, flags=True)
    return scenarios.scenario_report(demand, scenarios.parameter_table(t.spark, REPORTED), scenarios.effect_mapping(t.spark), "poisson")


@query("scenario_demand_noisy")
def scenario_demand_noisy(t):
    """All scenarios with their own noise; they share their uniforms, so no scenario of higher rates sells less."""
    effects = {name: calibrate.effects_from(p, scenarios.DEMAND_MAPPING)[0] for name, p in scenarios.SCENARIOS.items()}
    return synth.scenario_demand(calibrated(t), effects, horizon_start(t), 91, SEED, ENTITIES)


@query(
    "scenario_ratio",
    with_ctes("expected", f""", sums AS (SELECT scenario_id, CAST(sum(quantity) AS BIGINT) AS total, sum(quantity) FILTER (day_index >= 28 AND day_index < 42) AS inside,
  sum(quantity) FILTER (NOT (day_index >= 28 AND day_index < 42)) AS outside FROM expected GROUP BY ALL)
SELECT s.scenario_id, s.total, {r6('s.total / CAST(b.total AS DOUBLE)')} AS total_ratio, {r6('s.inside / CAST(b.inside AS DOUBLE)')} AS inside_ratio, {r6('s.outside / CAST(b.outside AS DOUBLE)')} AS outside_ratio
FROM sums s JOIN sums b ON b.scenario_id = 'baseline'"""),
)
def scenario_ratio(t):
    ratios = report.scenario_ratio(noise_free(t), "baseline", 28, 14)
    return ratios.withColumns({c: stable6(F.col(c)) for c in ("total_ratio", "inside_ratio", "outside_ratio")})


@query("initial_stock_target", with_ctes("mean_daily lead_items", f"SELECT product_id, store_id, mean_daily_demand, lead_time_mean_days, {even('mean_daily_demand * (lead_time_mean_days + order_cycle_days / 2.0)', 6)} AS initial_stock_target, CAST({even('mean_daily_demand * (lead_time_mean_days + order_cycle_days / 2.0)')} AS BIGINT) AS on_hand_units, CAST({even('60.0 * mean_daily_demand + 1')} AS BIGINT) AS capacity_units FROM mean_daily JOIN lead_items USING (product_id, store_id)"))
def initial_stock_target(t):
    from stockweave.functions.numeric import round_half_even_int

    joined = mean_daily(t).join(I.lead_items(t), list(ENTITIES))
    target = operations.stock_target(F.col("mean_daily_demand"), F.col("lead_time_mean_days"), F.col("order_cycle_days"))
    rows = joined.withColumn("initial_stock_target", target)
    return rows.select(
        *ENTITIES, "mean_daily_demand", "lead_time_mean_days", "initial_stock_target", round_half_even_int(F.col("initial_stock_target")).alias("on_hand_units"),
        round_half_even_int(60.0 * F.col("mean_daily_demand") + 1).alias("capacity_units"),
    )


_PS, _SUP = table_seed(SEED, "product_supplier"), table_seed(SEED, "supplier")
_U = lambda c, k, s: uniform(c, k, seed=s)
define(
    "ops_warehouse",
    f"""SELECT 'WH' || lpad(CAST(row_number() OVER (ORDER BY store_id) AS VARCHAR), 2, '0') AS warehouse_id, store_id,
CAST({even('total * 60.0 + 1.0')} AS BIGINT) AS capacity_units FROM (SELECT store_id, sum(mean_daily_demand) AS total FROM mean_daily GROUP BY ALL)""",
    "mean_daily",
)
define(
    "ops_product_supplier",
    f"""SELECT product_id, s.supplier_id, {even(even('avg_price', 4) + ' * 0.7', 2)} AS unit_cost,
CASE WHEN {_U('case_pack', 'product_id', _PS)} < {1 / 3!r}::DOUBLE THEN 6 WHEN {_U('case_pack', 'product_id', _PS)} < {2 / 3!r}::DOUBLE THEN 12 ELSE 24 END AS case_pack
FROM (SELECT product_id, avg(unit_price) AS avg_price FROM price GROUP BY ALL)
JOIN (SELECT s_suppkey AS supplier_id, row_number() OVER (ORDER BY s_suppkey) AS n, count(*) OVER () AS total FROM supplier) s
  ON s.n = CAST(floor({_U('supplier_id', 'product_id', _PS)} * s.total) AS BIGINT) + 1""",
    "price",
)


@query(
    "build_operations",
    with_ctes("mean_daily ops_warehouse ops_product_supplier lead", f"""SELECT product_id, store_id, warehouse_id, supplier_id, mean_daily_demand, lead_time_mean_days, unit_cost, CAST(case_pack AS BIGINT) AS case_pack, capacity_units,
    {even('mean_daily_demand * (lead_time_mean_days + 7.0)', 6)} AS initial_stock_target, CAST({even(even('mean_daily_demand * (lead_time_mean_days + 7.0)', 6))} AS BIGINT) AS on_hand_units, CAST(0 AS BIGINT) AS on_order_units,
    {even('20.0 + ' + _U('order_cost', 'supplier_id', _SUP) + ' * 40.0', 2)} AS order_cost, CAST(14 AS BIGINT) AS order_cycle_days, CAST(0.95 AS DOUBLE) AS target_service_level
    FROM mean_daily JOIN ops_warehouse USING (store_id) JOIN ops_product_supplier USING (product_id) JOIN lead USING (supplier_id)"""),
)
def build_operations(t):
    cfg = operations.OperationsConfig()
    suppliers = operations.build_suppliers(t.raw("supplier").select("s_suppkey"), "s_suppkey", SEED, cfg, keep_key=True)
    tables = operations.build_operations(I.sales_grid(t, t.day_totals), t.day_price, SEED, I.scalar(t.ship_bounds, "hi"), suppliers, t.lead_times, cfg)
    item = ["product_id", "warehouse_id"]
    return (
        tables["planning_input"]
        .join(tables["initial_inventory"], item)
        .join(tables["replenishment_policy"].drop("review_period_days"), item)
        .join(tables["product_supplier"], "product_id")
        .join(tables["warehouse"].select("warehouse_id", "capacity_units"), "warehouse_id")
        .join(tables["supplier"].select("supplier_id", "order_cost"), "supplier_id")
        .select("product_id", "store_id", "warehouse_id", "supplier_id", "mean_daily_demand", "lead_time_mean_days", "unit_cost", "case_pack", "capacity_units",
                "initial_stock_target", "on_hand_units", "on_order_units", "order_cost", "order_cycle_days", "target_service_level")
    )
