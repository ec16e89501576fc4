"""Named common table expressions for the oracle statements."""

from __future__ import annotations

from stockweave.sources.drivertables import SEED

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, body: str, *needs: str) -> None:
    _CTES[name] = (needs, body.strip())


def with_ctes(names: str, select: str) -> str:
    """``WITH`` clause with the named expressions and what they need, then ``select``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _CTES[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    clauses = ",\n".join(f"{n} AS MATERIALIZED (\n{_CTES[n][1]}\n)" for n in ordered)
    tail = select.strip()  # a leading comma continues the WITH clause
    return f"WITH {clauses}{tail}" if tail.startswith(",") else f"WITH {clauses}\n{tail}"


def r6(expression: str) -> str:
    """Six decimals, as ``stable6``."""
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6"


def even(expression: str, decimals: int = 0) -> str:
    """Half-even rounding, as ``round_half_even``."""
    if decimals == 0:
        return f"round_even(CAST({expression} AS DOUBLE), 0)"
    return f"round_even(CAST({expression} AS DOUBLE) * 1e{decimals}, 0) / 1e{decimals}"


def hash48(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"


def uniform(column: str, *key: str, seed: int = SEED) -> str:
    """U[0, 1), as ``seeded_uniform``."""
    parts = ", ".join([f"'{seed}'", f"'{column}'", *[f"CAST({k} AS VARCHAR)" for k in key]])
    return f"(CAST({hash48(f'concat_ws(chr(58), {parts})')} AS DOUBLE) / 281474976710656.0)"


def normal(column: str, *key: str, seed: int = SEED) -> str:
    """N(0, 1), as ``seeded_normal``."""
    u1, u2 = uniform(f"{column}.u1", *key, seed=seed), uniform(f"{column}.u2", *key, seed=seed)
    return f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos(2.0 * pi() * {u2}))"


define(
    "stores",
    """
SELECT s_suppkey, r_name AS store_id FROM supplier
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
)
define(
    "lines",
    f"""
SELECT CAST(l_shipdate AS DATE) AS date, l_orderkey, l_partkey, l_suppkey, p_type AS product_id, store_id,
       CAST(l_quantity AS BIGINT) AS quantity, CAST({even('l_extendedprice * 100')} AS BIGINT) AS cents
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN stores ON l_suppkey = s_suppkey
""",
    "stores",
)
define(
    "sales",
    """
SELECT date, product_id, store_id, CAST(sum(quantity) AS BIGINT) AS quantity FROM lines GROUP BY ALL
""",
    "lines",
)
define(
    "price",
    f"""
SELECT CAST(isoyear(date) * 100 + week(date) AS BIGINT) AS week_id, product_id, store_id,
       {even("CAST(sum(cents) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) / 100", 2)} AS unit_price
FROM lines GROUP BY ALL
""",
    "lines",
)
define("bounds", "SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem")
define(
    "calendar",
    """
SELECT date, CAST(isoyear(date) * 100 + week(date) AS BIGINT) AS week_id, CAST(isodow(date) AS BIGINT) AS weekday,
       CAST(month(date) AS BIGINT) AS month, CAST(year(date) AS BIGINT) AS year
FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds)
""",
    "bounds",
)
define(
    "grid",
    """
SELECT c.date, e.product_id, e.store_id, CAST(coalesce(s.quantity, 0) AS BIGINT) AS quantity,
       s.quantity IS NOT NULL AS observed
FROM calendar c CROSS JOIN (SELECT DISTINCT product_id, store_id FROM sales) e
LEFT JOIN sales s ON s.date = c.date AND s.product_id = e.product_id AND s.store_id = e.store_id
""",
    "calendar",
    "sales",
)
define(
    "lead",
    f"""
SELECT s_suppkey AS supplier_id,
       {even("4.0 + " + uniform("lead_time_mean_days", "s_suppkey") + " * 6.0", 2)} AS lead_time_mean_days,
       {even("0.5 + " + uniform("lead_time_std_days", "s_suppkey") + " * 1.5", 2)} AS lead_time_std_days,
       {even("0.85 + " + uniform("on_time_probability", "s_suppkey") + " * (0.99 - 0.85)", 3)} AS on_time_probability
FROM supplier
""",
)
define(
    "po",
    """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS po_id, p_type AS product_id,
       store_id AS warehouse_id, l_suppkey AS supplier_id, CAST(o_orderdate AS DATE) AS order_date,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN stores ON l_suppkey = s_suppkey GROUP BY ALL
""",
    "stores",
)
define("receipts", "SELECT date, product_id, store_id AS warehouse_id, quantity AS arrivals FROM sales", "sales")
define(
    "order_demand",
    """
SELECT CAST(o_orderdate AS DATE) AS date, p_type AS product_id, store_id AS warehouse_id,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS demand
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN stores ON l_suppkey = s_suppkey GROUP BY ALL
""",
    "stores",
)
# Thirteen weekly origins over the last 91 days, horizon 28.
define(
    "origins",
    """
SELECT CAST(unnest(generate_series(hi - 90, CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS origin_date FROM bounds
""",
    "bounds",
)
define("horizon", "SELECT CAST(unnest(generate_series(0, 27)) AS BIGINT) AS h")
define("entities", "SELECT DISTINCT product_id, store_id FROM sales", "sales")
define(
    "anchors",
    "SELECT origin_date, least(origin_date - 1, hi) AS anchor FROM origins CROSS JOIN bounds",
    "origins",
)
define(
    "fc_moving_average",
    """
SELECT l.origin_date, l.origin_date + CAST(h AS INTEGER) AS date, product_id, store_id, forecast
FROM (SELECT origin_date, product_id, store_id, avg(quantity) AS forecast FROM anchors
      JOIN grid ON grid.date <= anchor AND grid.date > anchor - 28 GROUP BY ALL) l CROSS JOIN horizon
""",
    "anchors",
    "grid",
    "horizon",
)
define(
    "fc_seasonal_naive",
    """
SELECT t.origin_date, t.date, t.product_id, t.store_id, coalesce(avg(g.quantity), 0) AS forecast
FROM (SELECT origin_date, anchor, origin_date + CAST(h AS INTEGER) AS date, product_id, store_id, k
      FROM anchors CROSS JOIN horizon CROSS JOIN entities
      CROSS JOIN (SELECT unnest(generate_series(0, 3)) AS k)) t
LEFT JOIN grid g ON g.product_id = t.product_id AND g.store_id = t.store_id
  AND g.date = t.date - CAST(7 * (ceil((t.date - t.anchor) / 7.0) + t.k) AS INTEGER)
GROUP BY ALL
""",
    "anchors",
    "grid",
    "horizon",
    "entities",
)
for _model in ("moving_average", "seasonal_naive"):
    define(
        f"bt_{_model}",
        f"""
SELECT f.*, CAST(g.quantity AS DOUBLE) AS actual FROM fc_{_model} f
LEFT JOIN grid g ON g.date = f.date AND g.product_id = f.product_id AND g.store_id = f.store_id
""",
        f"fc_{_model}",
        "grid",
    )
define(
    "lead_items",
    f"""
SELECT product_id, store_id, {even("4.0 + " + uniform("item_lead", "product_id", "store_id") + " * 6.0", 2)} AS lead_time_mean_days,
       CAST(14 AS BIGINT) AS order_cycle_days, CAST(0.95 AS DOUBLE) AS target_service_level
FROM entities
""",
    "entities",
)
define(
    "first_sale",
    "SELECT product_id, store_id, min(CASE WHEN quantity > 0 THEN date END) AS first FROM grid GROUP BY ALL",
    "grid",
)
# Mean units per day over the last 365 days of the table, leading zeros left out.
define(
    "mean_daily",
    f"""
SELECT product_id, store_id, {even("coalesce(avg(CASE WHEN date >= greatest(first, (SELECT hi - 364 FROM bounds)) THEN quantity END), 0)", 6)} AS mean_daily_demand
FROM grid JOIN first_sale USING (product_id, store_id) GROUP BY ALL
""",
    "grid",
    "first_sale",
    "bounds",
)
define(
    "moves",
    """
SELECT d.date, i.product_id, i.warehouse_id, CAST(coalesce(r.arrivals, 0) AS BIGINT) AS arrivals, CAST(coalesce(o.demand, 0) AS BIGINT) AS demand
FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM stock_bounds) d
CROSS JOIN (SELECT product_id, warehouse_id FROM receipts UNION SELECT product_id, warehouse_id FROM order_demand) i
LEFT JOIN receipts r ON r.date = d.date AND r.product_id = i.product_id AND r.warehouse_id = i.warehouse_id
LEFT JOIN order_demand o ON o.date = d.date AND o.product_id = i.product_id AND o.warehouse_id = i.warehouse_id
""",
    "stock_bounds", "receipts", "order_demand",
)
# Two runs (demand as recorded, demand one fifth higher) by three opening covers, on the same receipts.
define("variants", "SELECT * FROM (VALUES ('baseline', 5), ('stress', 6)) r(run_id, fifths) CROSS JOIN (VALUES ('cover_07', 7), ('cover_14', 14), ('cover_28', 28)) v(variant, cover)")
define(
    "ledgers",
    """
SELECT run_id, variant, date, product_id, warehouse_id, CAST(previous + arrivals AS BIGINT) AS opening_on_hand, arrivals, demand,
       CAST(previous + arrivals - closing AS BIGINT) AS fulfilled, CAST(demand - (previous + arrivals - closing) AS BIGINT) AS lost_sales, CAST(closing AS BIGINT) AS closing_on_hand
FROM (SELECT *, coalesce(lag(closing) OVER (PARTITION BY run_id, variant, product_id, warehouse_id ORDER BY date), opening) AS previous FROM (
  SELECT *, free - least(0, min(free) OVER (PARTITION BY run_id, variant, product_id, warehouse_id ORDER BY date)) AS closing FROM (
    SELECT *, opening + sum(arrivals - demand) OVER (PARTITION BY run_id, variant, product_id, warehouse_id ORDER BY date) AS free FROM (
      SELECT run_id, variant, date, product_id, warehouse_id, arrivals, demand * fifths // 5 AS demand,
             CAST(round_even(cover * avg(demand) OVER (PARTITION BY run_id, variant, product_id, warehouse_id), 0) AS BIGINT) AS opening
      FROM moves CROSS JOIN variants))))
""",
    "moves", "variants",
)
define("ledger", "SELECT * EXCLUDE (run_id, variant) FROM ledgers WHERE run_id = 'baseline' AND variant = 'cover_14'", "ledgers")
