"""Queries of sections A (sources, sinks, registry) and B (projections, filters)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions import calendar as C
from stockweave.functions.numeric import stable6
from stockweave.operators import lineage
from stockweave.operators import select as S
from stockweave.queries import inputs as I
from stockweave.queries.registry import query
from stockweave.queries.sqlparts import define, r6, with_ctes
from stockweave.schema import FieldSpec, TableSpec
from stockweave.sources import files, registry, retail, versions

ORDER_TEXT = TableSpec(
    "test.order_text",
    (FieldSpec("order_key", "int"), FieldSpec("total", "float"), FieldSpec("order_date", "date"),
     FieldSpec("finished", "bool", nullable=True), FieldSpec("priority", "str")),
)


@query(
    "scan_csv_typed",
    """SELECT o_orderkey AS order_key, o_totalprice AS total, CAST(o_orderdate AS DATE) AS order_date,
              CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS finished, o_orderpriority AS priority FROM orders""",
)
def scan_csv_typed(t):
    status = F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "no").otherwise("N/A")
    text = t.raw("orders").select(
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("order_key"),
        F.col("o_totalprice").cast("string").alias("total"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        status.alias("finished"),
        F.col("o_orderpriority").alias("priority"),
    )
    path = files.scratch_path(t.spark, "orders-text")
    text.write.option("header", True).csv(path)
    return files.read_csv_typed(t.spark, path, ORDER_TEXT)


EVENT_TEXT = TableSpec(
    "test.event_text",
    (FieldSpec("event_id", "int"), FieldSpec("value", "int"), FieldSpec("event_type", "date"), FieldSpec("props", "float"), FieldSpec("ts", "date")),
)


@query(
    "csv_bad_values",
    """
WITH bad AS (
  SELECT 'event_id' AS col, CAST(NULL AS VARCHAR) AS text FROM events WHERE false
  UNION ALL SELECT 'value', printf('%.2f', value) FROM events WHERE floor(value) <> value
  UNION ALL SELECT 'event_type', event_type FROM events
  UNION ALL SELECT 'props', props FROM events
  UNION ALL SELECT 'ts', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events WHERE date_trunc('day', ts) <> date_trunc('second', ts)),
ranked AS (SELECT col, text, row_number() OVER (PARTITION BY col ORDER BY text) AS r FROM (SELECT DISTINCT col, text FROM bad))
SELECT n.col AS "column", CAST((SELECT count(*) FROM bad b WHERE b.col = n.col) AS BIGINT) AS bad_count,
       coalesce((SELECT string_agg(text, '|' ORDER BY r) FROM ranked k WHERE k.col = n.col AND r <= 3), '') AS examples
FROM (VALUES ('event_id'), ('value'), ('event_type'), ('props'), ('ts')) n(col)
""",
)
def csv_bad_values(t):
    text = t.raw("events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.format_string("%.2f", "value").alias("value"),
        "event_type",
        "props",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
    )
    path = files.scratch_path(t.spark, "events-text")
    text.write.option("header", True).csv(path)
    return files.ingest_csv(t.spark, path, EVENT_TEXT).report.withColumn("examples", F.array_join("examples", "|"))


CUSTOMER = TableSpec(
    "test.customer",
    tuple(FieldSpec(n, k) for n, k in (("c_mktsegment", "str"), ("c_custkey", "int"), ("c_name", "str"), ("c_nationkey", "int"), ("c_acctbal", "float"))),
)


@query("scan_parquet_strict", "SELECT c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def scan_parquet_strict(t):
    return files.read_parquet_strict(t.spark, f"{t.path}/customer.parquet", CUSTOMER)


@query(
    "scan_wide_sales",
    with_ctes("grid", """SELECT product_id AS item_id, store_id, CAST(count(*) AS BIGINT) AS day_columns, CAST(sum(quantity) AS BIGINT) AS units,
              CAST(max_by(quantity, date) AS BIGINT) AS last_day_units FROM grid GROUP BY ALL"""),
)
def scan_wide_sales(t):
    path = files.scratch_path(t.spark, "wide-sales")
    files.write_csv(I.wide_sales(t), path)
    wide = retail.read_wide_sales(t.spark, path)
    days = retail.day_columns(wide)
    return wide.select(
        "item_id", "store_id", F.lit(len(days)).cast("bigint").alias("day_columns"),
        retail.row_total(days).alias("units"), F.col(days[-1]).alias("last_day_units"),
    )


@query(
    "subset_extract",
    with_ctes(
        "sales price",
        """, kept AS (SELECT * FROM sales WHERE store_id IN ('ASIA', 'EUROPE')),
top AS (SELECT product_id FROM kept GROUP BY product_id ORDER BY sum(quantity) DESC, product_id LIMIT 4),
rows AS (SELECT product_id, store_id, CAST(sum(quantity) AS BIGINT) AS units FROM kept WHERE product_id IN (SELECT product_id FROM top) GROUP BY ALL)
SELECT product_id AS item_id, store_id, units, CAST(count(*) AS BIGINT) AS price_rows
FROM rows JOIN price USING (product_id, store_id) GROUP BY ALL""",
    ),
)
def subset_extract(t):
    """Two stores and their four best items, taken out of the wide file and the price file."""
    sales_path, price_path = files.scratch_path(t.spark, "wide-sales"), files.scratch_path(t.spark, "sell-prices")
    files.write_csv(I.wide_sales(t), sales_path)
    prices = t.price.select("store_id", F.col("product_id").alias("item_id"), F.col("week_id").alias("wm_yr_wk"), F.col("unit_price").alias("sell_price"))
    files.write_csv(prices, price_path, {"sell_price": 2})
    wide, stored = retail.read_wide_sales(t.spark, sales_path), t.spark.read.option("header", True).csv(price_path)
    rows, kept = retail.extract_subset(wide, stored, stores=["ASIA", "EUROPE"], top=4)
    counts = kept.groupBy("item_id", "store_id").agg(F.count(F.lit(1)).alias("price_rows"))
    return rows.select("item_id", "store_id", retail.row_total(retail.day_columns(rows)).alias("units")).join(counts, ["item_id", "store_id"])


SALES_SQL = "SELECT date, product_id, store_id, quantity FROM sales"


@query("sink_parquet_verified", with_ctes("sales", SALES_SQL))
def sink_parquet_verified(t):
    path = files.scratch_path(t.spark, "sales")
    files.write_parquet_verified(t.sales, path)
    return t.spark.read.parquet(path)


@query("read_verified", with_ctes("sales", SALES_SQL))
def read_verified(t):
    path = files.scratch_path(t.spark, "sales")
    fingerprint = files.write_parquet_verified(t.sales, path)
    return files.read_verified(t.spark, path, fingerprint)


@query(
    "publish_versions",
    with_ctes("sales", """SELECT 1 AS version, date, product_id, store_id, quantity FROM sales
              UNION ALL SELECT 2, date, product_id, store_id, CASE WHEN store_id = 'ASIA' THEN 2 * quantity ELSE quantity END FROM sales"""),
)
def publish_versions(t):
    """A table published by store, then one store replaced: both versions as readers see them."""
    root = files.scratch_path(t.spark, "sales-versions")
    sales = t.sales.select("date", "product_id", "store_id", "quantity")
    first = versions.publish(sales, root, "store_id").number
    second = versions.replace_part(sales.where("store_id = 'ASIA'").withColumn("quantity", 2 * F.col("quantity")), root).number
    parts = [versions.read_verified(t.spark, root, n).select(F.lit(n).alias("version"), "*") for n in (first, second)]
    return parts[0].unionByName(parts[1])


@query(
    "partition_audit",
    with_ctes("sales", """SELECT store_id, CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) + CASE WHEN store_id = 'EUROPE' THEN count(*) FILTER (quantity >= 40) ELSE 0 END AS BIGINT) AS found_rows,
              store_id <> 'EUROPE' OR count(*) FILTER (quantity >= 40) = 0 AS intact FROM sales GROUP BY store_id"""),
)
def partition_audit(t):
    """Rows slipped into one partition's files after the commit: the audit names that partition."""
    root = files.scratch_path(t.spark, "sales-audited")
    sales = t.sales.select("date", "product_id", "store_id", "quantity")
    published = versions.publish(sales, root, "store_id")
    folder = next(p.folder for p in published.parts if p.value == "EUROPE")
    sales.where("store_id = 'EUROPE' AND quantity >= 40").write.mode("append").parquet(folder)
    return versions.audit(t.spark, root).withColumnRenamed("value", "store_id")


PRICE_SPEC = TableSpec(
    "retail.price_csv",
    (FieldSpec("week_id", "int"), FieldSpec("product_id", "str"), FieldSpec("store_id", "str"), FieldSpec("unit_price", "float")),
)


@query("sink_csv", with_ctes("price", "SELECT week_id, product_id, store_id, unit_price FROM price"))
def sink_csv(t):
    path = files.scratch_path(t.spark, "prices")
    files.write_csv(t.price, path, {"unit_price": 2})
    return files.read_csv_typed(t.spark, path, PRICE_SPEC)


@query(
    "registry_append",
    with_ctes("registry", """SELECT r.* FROM registry r WHERE r.source_type = 'derived' OR NOT EXISTS (SELECT 1 FROM registry o WHERE o.source_type = 'derived'
              AND o.dataset_id = r.dataset_id AND o.version = r.version)"""),
)
def registry_append(t):
    entries, path = I.monthly_registry(t), files.scratch_path(t.spark, "registry")
    registry.append_entries(entries.where("source_type = 'derived'"), path)
    registry.append_entries(registry.accepted_entries(entries, registry.read_registry(t.spark, path)), path)
    return registry.read_registry(t.spark, path).select(*entries.columns)


@query(
    "registry_latest",
    with_ctes("registry", "SELECT * FROM registry QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY seq DESC) = 1"),
)
def registry_latest(t):
    return registry.latest_entries(I.monthly_registry(t))


@query("registry_list", with_ctes("registry", "SELECT * FROM registry WHERE source_type = 'reference'"))
def registry_list(t):
    return registry.list_entries(I.monthly_registry(t), "reference")


@query(
    "provenance_rows",
    with_ctes("edges", """SELECT dataset_id, version, CAST(count(*) AS BIGINT) AS n_inputs, min(input_version) AS first_input_version,
        'quarter_rollup' AS component, 'quarter' AS grain, 'union|sum' AS steps, CAST(sum(row_count) AS BIGINT) AS output_rows,
        CAST('0x' || substr(md5(dataset_id || ':' || version), 1, 12) AS BIGINT) AS seed FROM edges GROUP BY ALL"""),
)
def provenance_rows(t):
    stored = registry.provenance_json(I.quarter_provenance(t))
    read = registry.parse_provenance(stored)
    return read.select(
        "dataset_id", "version", F.size("inputs").cast("bigint").alias("n_inputs"),
        F.array_min(F.transform("inputs", lambda x: x["version"])).alias("first_input_version"),
        "component", F.element_at("parameters", "grain").alias("grain"), F.array_join("steps", "|").alias("steps"), "output_rows", "seed",
    )


@query(
    "lineage_edges",
    with_ctes("edges", """SELECT dataset_id, version, input_id, input_version, pinned_fingerprint,
              pinned_fingerprint AS current_fingerprint, false AS drifted FROM edges"""),
)
def lineage_edges(t):
    edges = registry.lineage_edges(I.quarter_provenance(t))
    return registry.drifted_edges(edges, I.monthly_registry(t)).select(
        "dataset_id", "version", "input_id", "input_version", "pinned_fingerprint", "current_fingerprint", "drifted"
    )


def artifact_edges(t):
    """Months -> quarters -> years -> whole histories of every store -> one report over all stores."""
    edges = registry.lineage_edges(I.quarter_provenance(t)).select("dataset_id", "version", "input_id", "input_version")
    quarters = edges.select("dataset_id", "version").distinct()
    store, year = F.substring_index("dataset_id", ".quarter", 1), F.substring_index("version", ".", 1)
    years = quarters.select(F.concat(store, F.lit(".year")).alias("dataset_id"), year.alias("version"), F.col("dataset_id").alias("input_id"), F.col("version").alias("input_version"))
    histories = years.select(F.concat(F.substring_index("dataset_id", ".year", 1), F.lit(".all")).alias("dataset_id"), F.lit("1").alias("version"), F.col("dataset_id").alias("input_id"), F.col("version").alias("input_version")).distinct()
    report = histories.select(F.lit("sales.report").alias("dataset_id"), F.lit("1").alias("version"), F.col("dataset_id").alias("input_id"), F.col("version").alias("input_version")).distinct()
    return edges.unionByName(years).unionByName(histories).unionByName(report)


define(
    "artifact_edges",
    """
SELECT DISTINCT * FROM (
  SELECT dataset_id, version, input_id, input_version FROM edges
  UNION ALL SELECT replace(dataset_id, '.quarter', '.year'), split_part(version, '.', 1), dataset_id, version FROM edges
  UNION ALL SELECT replace(dataset_id, '.quarter', '.all'), '1', replace(dataset_id, '.quarter', '.year'), split_part(version, '.', 1) FROM edges
  UNION ALL SELECT 'sales.report', '1', replace(dataset_id, '.quarter', '.all'), '1' FROM edges)
""",
    "edges",
)


@query(
    "lineage_ancestors",
    with_ctes("artifact_edges", """, reach AS (
  SELECT dataset_id, version, input_id, input_version, 1 AS depth FROM artifact_edges
  UNION SELECT r.dataset_id, r.version, e.input_id, e.input_version, r.depth + 1 FROM reach r JOIN artifact_edges e ON e.dataset_id = r.input_id AND e.version = r.input_version)
SELECT dataset_id, version, input_id AS ancestor_id, input_version AS ancestor_version, CAST(min(depth) AS BIGINT) AS depth, input_id = 'sales.asia.quarter' AS drifted
FROM reach GROUP BY ALL""").replace("WITH ", "WITH RECURSIVE ", 1),
)
def lineage_ancestors(t):
    """Everything each artifact was made from; the quarters of one store have been registered anew since."""
    return lineage.ancestors(artifact_edges(t), F.col("input_id") == "sales.asia.quarter")


@query(
    "lineage_impact",
    with_ctes("artifact_edges", """, reach AS (
  SELECT dataset_id, version, input_id, input_version, 1 AS depth FROM artifact_edges
  UNION SELECT r.dataset_id, r.version, e.input_id, e.input_version, r.depth + 1 FROM reach r JOIN artifact_edges e ON e.dataset_id = r.input_id AND e.version = r.input_version)
SELECT input_id AS dataset_id, input_version AS version, CAST(count(DISTINCT (dataset_id, version)) AS BIGINT) AS dependants, CAST(max(depth) AS BIGINT) AS furthest
FROM reach GROUP BY ALL""").replace("WITH ", "WITH RECURSIVE ", 1),
)
def lineage_impact(t):
    return lineage.impact(artifact_edges(t))


# --- B: projections and filters -----------------------------------------------------------------

PART = TableSpec("test.part", (FieldSpec("p_type", "str"), FieldSpec("p_partkey", "int"), FieldSpec("p_retailprice", "float")))


@query("project_schema_order", "SELECT p_type, p_partkey, p_retailprice FROM part")
def project_schema_order(t):
    return S.project(t.raw("part"), PART)


@query("rename_columns", "SELECT p_partkey AS product_key, p_brand AS department_id, p_type AS category_id FROM part")
def rename_columns(t):
    names = {"p_partkey": "product_key", "p_brand": "department_id", "p_type": "category_id"}
    return t.raw("part").select(*names).withColumnsRenamed(names)


@query("filter_isin", "SELECT p_partkey, p_brand, p_type FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def filter_isin(t):
    parts = t.raw("part").select("p_partkey", "p_brand", "p_type", "p_size")
    return retail.filter_isin(parts, p_type=["ECONOMY", "SMALL"], p_brand=["Brand#1", "Brand#2", "Brand#3"], p_size=None).drop("p_size")


@query("filter_entity_eq", "SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag FROM lineitem WHERE CAST(l_linenumber AS VARCHAR) = '3' AND l_returnflag = 'A'")
def filter_entity_eq(t):
    return S.filter_entities(t.raw("lineitem"), {"l_linenumber": "3", "l_returnflag": "A"}).select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")


@query("filter_before_origin", with_ctes("sales bounds", "SELECT date, product_id, store_id, quantity FROM sales WHERE date < (SELECT hi - 90 FROM bounds)"))
def filter_before_origin(t):
    return S.before_origin(t.sales, "date", F.date_sub(I.scalar(t.ship_bounds, "hi"), 90))


@query("filter_last_n_days", with_ctes("sales bounds", "SELECT date, product_id, store_id, quantity FROM sales WHERE date > (SELECT hi - 365 FROM bounds)"))
def filter_last_n_days(t):
    return S.last_n_days(t.sales, "date", 365, t.ship_bounds)


DAY = "date - (SELECT lo FROM bounds)"


@query(
    "shock_window_factor",
    with_ctes("sales bounds", f"""SELECT date, product_id, store_id, quantity, CASE WHEN {DAY} >= 28 AND {DAY} < 42 THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS factor,
              1.0::DOUBLE AS no_shock FROM sales"""),
)
def shock_window_factor(t):
    day = C.day_index(F.col("date"), I.scalar(t.ship_bounds, "lo"))
    return t.sales.withColumns({"factor": C.shock_factor(day, 28, 14, 2.5), "no_shock": C.shock_factor(day, 28, 0, 2.5)})


@query(
    "disruption_window_flag",
    with_ctes("sales bounds", f"""SELECT date, product_id, store_id, quantity, ({DAY} >= 28 AND {DAY} < 70) AS in_window, ({DAY} >= 28) AS open_ended FROM sales"""),
)
def disruption_window_flag(t):
    day = C.day_index(F.col("date"), I.scalar(t.ship_bounds, "lo"))
    return t.sales.withColumns({"in_window": C.disruption_flag(day, 28, 42), "open_ended": C.disruption_flag(day, 28, 0)})


@query(
    "event_day_factor",
    with_ctes("sales calendar_source", """SELECT s.date, product_id, store_id, quantity,
              CASE WHEN event_name_1 IS NOT NULL THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM sales s JOIN calendar_source c ON s.date = c.date"""),
)
def event_day_factor(t):
    return S.event_factor(t.sales, retail.event_calendar(t.calendar), "date", 1.5)


@query("literal_columns", with_ctes("sales", "SELECT *, 'none' AS scenario_id, 'units' AS unit, CAST(1 AS BIGINT) AS schema_major FROM sales"))
def literal_columns(t):
    return S.literal_columns(t.sales, {"unit": "units", "schema_major": 1}, scenario_id=None)


@query("drop_nulls", with_ctes("bt_moving_average", f"SELECT origin_date, date, product_id, store_id, {r6('forecast')} AS forecast, actual FROM bt_moving_average WHERE actual IS NOT NULL"))
def drop_nulls(t):
    from stockweave.queries.forecasting import backtest_of

    return backtest_of(t, "moving_average").dropna(subset=["actual"]).withColumn("forecast", stable6(F.col("forecast")))
