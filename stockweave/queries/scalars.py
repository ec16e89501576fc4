"""Queries of section I (scalar functions), each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions import calendar as C
from stockweave.functions import numeric as N
from stockweave.functions.random import hash48, seeded_uniform
from stockweave.plans.synth import lookup_value
from stockweave.queries.aggregates import factors
from stockweave.queries.inputs import ENTITIES
from stockweave.queries.registry import query
from stockweave.queries.sqlparts import even, hash48 as sql_hash48, r6, uniform, with_ctes
from stockweave.sources.drivertables import SEED


@query(
    "fn_string",
    """SELECT c_custkey, lower(trim('  ' || c_mktsegment || ' ')) AS segment, starts_with(c_mktsegment, 'MA') AS is_ma, 'C' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS padded,
       concat_ws('|', c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS joined, split_part(c_name, '#', 2) AS number_text,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'b2b' WHEN 'HOUSEHOLD' THEN 'b2c' ELSE 'other' END AS channel FROM customer""",
)
def fn_string(t):
    segment, name = F.col("c_mktsegment"), F.col("c_name")
    return t.raw("customer").select(
        "c_custkey",
        F.lower(F.trim(F.concat(F.lit("  "), segment, F.lit(" ")))).alias("segment"),
        F.startswith(segment, F.lit("MA")).alias("is_ma"),
        F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("padded"),
        F.concat_ws("|", name, segment, F.col("c_nationkey").cast("string")).alias("joined"),
        F.get(F.split(name, "#"), F.lit(1)).alias("number_text"),
        lookup_value(segment, {"BUILDING": "b2b", "HOUSEHOLD": "b2c"}, "other").alias("channel"),
    )


@query(
    "fn_date",
    """SELECT o_orderkey, d AS parsed, CAST(isodow(d) - 1 AS BIGINT) AS monday0, CAST(isodow(d) AS BIGINT) AS iso, CAST(((isodow(d) + 1) % 7 + 1 + 4) % 7 + 1 AS BIGINT) AS recoded,
       CAST(month(d) AS BIGINT) AS month, CAST(year(d) AS BIGINT) AS year, CAST(day(d) AS BIGINT) AS day, CAST(dayofyear(d) AS BIGINT) AS day_of_year, dayname(d) AS day_name,
       CAST(d + 10 AS DATE) AS later, CAST(d - 3 AS DATE) AS earlier, CAST(d - DATE '1995-01-01' AS BIGINT) AS age, o_orderdate <> date_trunc('day', o_orderdate) AS has_time,
       strftime(d, '%Y-%m-%d') AS iso_text FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def fn_date(t):
    d = F.col("parsed")
    orders = t.raw("orders").select("o_orderkey", "o_orderdate", F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd"), "yyyy-MM-dd").alias("parsed"))
    return orders.select(
        "o_orderkey", "parsed", C.weekday_monday0(d).alias("monday0"), C.iso_weekday(d).alias("iso"),
        C.saturday_weekday_to_iso((C.iso_weekday(d) + 1) % 7 + 1).alias("recoded"),
        F.month(d).cast("bigint").alias("month"), F.year(d).cast("bigint").alias("year"), F.dayofmonth(d).cast("bigint").alias("day"),
        F.dayofyear(d).cast("bigint").alias("day_of_year"), F.date_format(d, "EEEE").alias("day_name"), C.plus_days(d, 10).alias("later"),
        F.date_sub(d, 3).alias("earlier"), C.day_index(d, F.lit("1995-01-01").cast("date")).alias("age"), C.has_time_part(F.col("o_orderdate")).alias("has_time"),
        F.date_format(d, "yyyy-MM-dd").alias("iso_text"),
    )


@query(
    "fn_math",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE AS day, {even('l_extendedprice / 1000', 2)} AS half_even_2, CAST({even('l_quantity / 4')} AS BIGINT) AS half_even_int,
       CAST(ceil(l_quantity / 12.0) * 12 AS BIGINT) AS packs, greatest(l_quantity - 25, 0.0) AS floored, least(l_quantity, 40.0) AS capped, CAST(l_partkey % 7 AS BIGINT) AS remainder,
       abs(l_quantity - 25) AS distance, l_quantity * l_quantity AS squared, {r6('sqrt(l_quantity)')} AS root, {r6('sin(l_quantity)')} AS sine, {r6('exp(l_discount)')} AS grown, {r6('ln(l_quantity)')} AS logged,
       CASE WHEN l_tax > 0 THEN {r6('l_discount / l_tax')} END AS safe_ratio FROM lineitem""",
)
def fn_math(t):
    q = F.col("l_quantity")
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("day"),
        N.round_half_even(F.col("l_extendedprice") / 1000, 2).alias("half_even_2"), N.round_half_even_int(q / 4).alias("half_even_int"),
        N.ceil_to_multiple(q, F.lit(12)).alias("packs"), N.clip(q - 25, low=0.0).alias("floored"), N.clip(q, high=40.0).alias("capped"),
        (F.col("l_partkey") % 7).alias("remainder"), F.abs(q - 25).alias("distance"), (q * q).alias("squared"), N.stable6(F.sqrt(q)).alias("root"),
        N.stable6(F.sin(q)).alias("sine"), N.stable6(F.exp("l_discount")).alias("grown"), N.stable6(F.ln(q)).alias("logged"),
        N.stable6(N.ratio_or_null(F.col("l_discount"), F.col("l_tax"))).alias("safe_ratio"),
    )


@query(
    "fn_conditional",
    with_ctes("grid", """SELECT g.date, g.product_id, g.store_id, CASE WHEN observed THEN quantity END AS raw, quantity AS filled, NOT observed AS is_missing,
    g.store_id IN ('ASIA', 'EUROPE') AS is_member, CASE WHEN quantity = 0 THEN 'none' WHEN quantity < 50 THEN 'low' ELSE 'high' END AS kind FROM grid g"""),
)
def fn_conditional(t):
    from stockweave.operators.spine import reindex_to_spine

    cells = reindex_to_spine(t.sales, "date", ENTITIES, "quantity", t.ship_bounds)
    filled = F.coalesce("quantity", F.lit(0))
    return cells.select(
        "date", *ENTITIES, F.col("quantity").alias("raw"), filled.cast("bigint").alias("filled"), F.col("quantity").isNull().alias("is_missing"),
        F.col("store_id").isin("ASIA", "EUROPE").alias("is_member"), F.when(filled == 0, "none").when(filled < 50, "low").otherwise("high").alias("kind"),
    )


@query(
    "fn_array_map",
    with_ctes("weekly monthly calendar", f"""SELECT c.date, w.product_id, w.store_id, w.factor AS weekday_factor, m.factor AS month_factor, a.mean_factor, a.min_factor,
    CASE w.store_id WHEN 'ASIA' THEN CAST(1 AS BIGINT) WHEN 'EUROPE' THEN CAST(2 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS zone
    FROM calendar c JOIN weekly w ON w.key = c.weekday - 1 JOIN monthly m ON m.key = c.month AND m.product_id = w.product_id AND m.store_id = w.store_id
    JOIN (SELECT product_id, store_id, {r6('avg(factor)')} AS mean_factor, min(factor) AS min_factor FROM weekly GROUP BY ALL) a ON a.product_id = w.product_id AND a.store_id = w.store_id"""),
)
def fn_array_map(t):
    from stockweave.operators.spine import date_sequence
    from stockweave.queries.inputs import scalar

    profiles = factors(t)
    days = profiles.select("*", F.explode(date_sequence(scalar(t.ship_bounds, "lo"), scalar(t.ship_bounds, "hi"))).alias("date"))
    mean = F.aggregate("weekly", F.lit(0.0), lambda a, x: a + x) / F.size("weekly")
    zone = F.coalesce(F.element_at(F.create_map(F.lit("ASIA"), F.lit(1), F.lit("EUROPE"), F.lit(2)), F.col("store_id")), F.lit(0))
    return days.select(
        "date", *ENTITIES, F.get("weekly", F.weekday("date")).alias("weekday_factor"), F.get("monthly", F.month("date") - 1).alias("month_factor"),
        N.stable6(mean).alias("mean_factor"), F.array_min("weekly").alias("min_factor"), zone.cast("bigint").alias("zone"),
    )


@query(
    "fn_json",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(to_json({'event_id': event_id, 'day': strftime(ts, '%Y-%m-%d'), 'event_type': event_type}) AS VARCHAR) AS record,
       strftime(ts, '%Y-%m-%d') AS day_again, json_extract_string(props, '$.k') AS k_text FROM events""",
)
def fn_json(t):
    row = F.struct("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    written = t.raw("events").select("event_id", "props", F.to_json(row).alias("record"))
    read = F.from_json("record", "event_id bigint, day string, event_type string")
    return written.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), "record", read["day"].alias("day_again"), F.get_json_object("props", "$.k").alias("k_text"))


@query(
    "fn_hash",
    f"""SELECT doc_id, sha256(text) AS text_hash, md5(text) AS text_md5, CAST('0x' || substr(sha256('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS derived_seed, {sql_hash48('text')} AS h48 FROM documents""",
)
def fn_hash(t):
    seed = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(SEED)), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    return t.raw("documents").select("doc_id", F.sha2("text", 256).alias("text_hash"), F.md5("text").alias("text_md5"), seed.alias("derived_seed"), hash48(F.col("text")).alias("h48"))


@query("fn_seeded_uniform", f"SELECT o_orderkey, {uniform('noise', 'o_orderkey')} AS u, {uniform('other', 'o_orderkey', 'o_custkey')} AS v FROM orders")
def fn_seeded_uniform(t):
    return t.raw("orders").select("o_orderkey", seeded_uniform(SEED, "noise", F.col("o_orderkey")).alias("u"), seeded_uniform(SEED, "other", F.col("o_orderkey"), F.col("o_custkey")).alias("v"))
