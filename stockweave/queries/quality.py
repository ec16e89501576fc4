"""Queries of section Q (data-quality checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.operators import aggregates as A
from stockweave.operators import quality as Q
from stockweave.queries.registry import query
from stockweave.queries.sqlparts import define, with_ctes
from stockweave.schema import FieldSpec, ForeignKey, Integer, NotNull, Range, Relation, TableSpec, Unique

LINE = TableSpec(
    "shop.line",
    (FieldSpec("l_orderkey", "int"), FieldSpec("l_linenumber", "int", min=1, max=7), FieldSpec("l_partkey", "int"),
     FieldSpec("l_quantity", "float", min=2, max=49), FieldSpec("l_extendedprice", "int"), FieldSpec("l_discount", "float", nullable=True, max=0.08),
     FieldSpec("l_tax", "float"), FieldSpec("l_returnflag", "category", allowed_values=("A", "R")), FieldSpec("l_shipdate", "date")),
    primary_key=("l_orderkey", "l_linenumber"),
    foreign_keys=(ForeignKey(("l_orderkey",), "shop.order", ("o_orderkey",)), ForeignKey(("l_partkey",), "shop.part", ("p_partkey",))),
)
LINE_CONSTRAINTS = (
    Range("l_tax", 0, 0.07), NotNull("l_returnflag"), Unique(("l_orderkey", "l_partkey")), Integer("l_extendedprice"), Integer("l_quantity"),
    Relation("l_discount", "<=", "l_tax"), Relation("l_discount", "<", "l_returnflag"), ForeignKey(("l_suppkey",), "shop.supplier", ("s_suppkey",)),
    Range("l_comment", 0, 1),
)
EVENT = TableSpec(
    "shop.event",
    (FieldSpec("event_id", "int"), FieldSpec("ts", "date"), FieldSpec("user_id", "int"),
     FieldSpec("event_type", "category", allowed_values=("click", "view", "purchase")), FieldSpec("value", "float", min=0, max=50)),
    primary_key=("event_id",),
    foreign_keys=(ForeignKey(("user_id",), "shop.customer", ("c_custkey",)),),
)
ORDER = TableSpec("shop.order", (FieldSpec("o_orderkey", "int"), FieldSpec("o_custkey", "int"), FieldSpec("o_totalprice", "float", min=0)),
                  primary_key=("o_orderkey",), foreign_keys=(ForeignKey(("o_custkey",), "shop.customer", ("c_custkey",)),))
PART = TableSpec("shop.part", (FieldSpec("p_partkey", "int"), FieldSpec("p_size", "int", min=1, max=40)), primary_key=("p_partkey",))


def tables(t):
    return {
        "event": (EVENT, t.raw("events")), "line": (LINE, t.raw("lineitem")), "order": (ORDER, t.raw("orders")), "part": (PART, t.raw("part")),
    }


def line_report(t, *only):
    references = {"shop.order": t.raw("orders"), "shop.part": t.raw("part")}
    return Q.validate_table(t.raw("lineitem"), LINE, LINE_CONSTRAINTS, references, only or None)


def event_report(t, *only):
    return Q.validate_table(t.raw("events"), EVENT, (), {"shop.customer": t.raw("customer")}, only or None)


def both(t, *only):
    return line_report(t, *only).unionByName(event_report(t, *only)).select("check", "target", "status", "violations")


def _row(check: str, target: str, count: str, table: str, status: str | None = None) -> str:
    state = f"'{status}'" if status else f"CASE WHEN {count} > 0 THEN 'failed' ELSE 'passed' END"
    return f"SELECT '{check}' AS \"check\", '{target}' AS target, {state} AS status, CAST({count} AS BIGINT) AS violations FROM {table}"


def _count(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


_SKIP = lambda check, target: f"SELECT '{check}', '{target}', 'skipped', CAST(0 AS BIGINT)"
_FAIL = lambda check, target: f"SELECT '{check}', '{target}', 'failed', CAST(0 AS BIGINT)"
_DUP = lambda keys, table: f"(SELECT count(*) - count(DISTINCT ({keys})) FROM {table})"
_ORPHAN = lambda field, table, ref, parent: f"(SELECT count(*) FROM {table} WHERE {field} NOT IN (SELECT {ref} FROM {parent}))"

LINE_ROWS = {
    "dtype": [
        *[_row("dtype", f"shop.line.{c}", "0 * count(*)", "lineitem") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")],
        _row("dtype", "shop.line.l_extendedprice", "count(l_extendedprice)", "lineitem", "failed"),
        _row("dtype", "shop.line.l_shipdate", _count("l_shipdate <> date_trunc('day', l_shipdate)"), "lineitem"),
    ],
    "not_null": [
        *[_row("not_null", f"shop.line.{c}", _count(f"{c} IS NULL"), "lineitem")
          for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_shipdate", "l_returnflag")],
    ],
    "range": [
        _row("range", "shop.line.l_linenumber", _count("l_linenumber < 1 OR l_linenumber > 7"), "lineitem"),
        _row("range", "shop.line.l_quantity", _count("l_quantity < 2 OR l_quantity > 49"), "lineitem"),
        _row("range", "shop.line.l_discount", _count("l_discount > 0.08::DOUBLE"), "lineitem"),
        _row("range", "shop.line.l_tax", _count("l_tax < 0 OR l_tax > 0.07::DOUBLE"), "lineitem"),
        _FAIL("range", "shop.line.l_comment"),
    ],
    "allowed_values": [_row("allowed_values", "shop.line.l_returnflag", _count("l_returnflag NOT IN ('A', 'R')"), "lineitem")],
    "integer": [_row("integer", "shop.line.l_extendedprice", _count("l_extendedprice <> floor(l_extendedprice)"), "lineitem"),
                _row("integer", "shop.line.l_quantity", _count("l_quantity <> floor(l_quantity)"), "lineitem")],
    "relation": [_row("relation", "shop.line.l_discount <= l_tax", _count("NOT (l_discount <= l_tax)"), "lineitem"),
                 _SKIP("relation", "shop.line.l_discount < l_returnflag")],
    "unique": [_row("unique", "shop.line.l_orderkey+l_partkey", _DUP("l_orderkey, l_partkey", "lineitem"), "(SELECT 1)")],
    "primary_key": [_row("primary_key", "shop.line.l_orderkey+l_linenumber", _DUP("l_orderkey, l_linenumber", "lineitem"), "(SELECT 1)")],
    "foreign_key": [_row("foreign_key", "shop.line.l_orderkey -> shop.order.o_orderkey", _ORPHAN("l_orderkey", "lineitem", "o_orderkey", "orders"), "(SELECT 1)"),
                    _row("foreign_key", "shop.line.l_partkey -> shop.part.p_partkey", _ORPHAN("l_partkey", "lineitem", "p_partkey", "part"), "(SELECT 1)"),
                    _SKIP("foreign_key", "shop.line.l_suppkey -> shop.supplier.s_suppkey")],
}
EVENT_ROWS = {
    "dtype": [*[_row("dtype", f"shop.event.{c}", "0 * count(*)", "events") for c in ("event_id", "user_id", "event_type", "value")],
              _row("dtype", "shop.event.ts", _count("ts <> date_trunc('day', ts)"), "events")],
    "not_null": [_row("not_null", f"shop.event.{c}", _count(f"{c} IS NULL"), "events") for c in ("event_id", "ts", "user_id", "event_type", "value")],
    "range": [_row("range", "shop.event.value", _count("value < 0 OR value > 50"), "events")],
    "allowed_values": [_row("allowed_values", "shop.event.event_type", _count("event_type NOT IN ('click', 'view', 'purchase')"), "events")],
    "primary_key": [_row("primary_key", "shop.event.event_id", _DUP("event_id", "events"), "(SELECT 1)")],
    "foreign_key": [_row("foreign_key", "shop.event.user_id -> shop.customer.c_custkey", _ORPHAN("user_id", "events", "c_custkey", "customer"), "(SELECT 1)")],
}


def _union(*groups: dict[str, list[str]], only: str | None = None) -> str:
    return "\nUNION ALL ".join(row for g in groups for check, rows in g.items() if only in (None, check) for row in rows)


for _check in ("dtype", "not_null", "range", "allowed_values", "integer", "relation", "unique", "primary_key", "foreign_key"):
    query(f"check_{_check}", _union(LINE_ROWS, EVENT_ROWS, only=_check))(lambda t, c=_check: both(t, c))

GAPS = TableSpec(
    "shop.gaps", (FieldSpec("l_orderkey", "int"), FieldSpec("l_discount", "float", nullable=True, min=0, max=0.08), FieldSpec("l_tax", "float")),
    constraints=(Integer("l_discount"), Relation("l_discount", "<=", "l_tax"), Relation("l_tax", "<=", "l_discount"), Unique(("l_orderkey", "l_tax"))),
)
_GAPS = "(SELECT l_orderkey, CASE WHEN l_linenumber <> 3 THEN l_discount END AS l_discount, CASE WHEN l_linenumber <> 5 THEN l_tax END AS l_tax FROM lineitem)"
GAP_ROWS = [
    *[_row("dtype", f"shop.gaps.{c}", "0 * count(*)", _GAPS) for c in ("l_orderkey", "l_discount", "l_tax")],
    *[_row("not_null", f"shop.gaps.{c}", _count(f"{c} IS NULL"), _GAPS) for c in ("l_orderkey", "l_tax")],
    _row("range", "shop.gaps.l_discount", _count("l_discount < 0 OR l_discount > 0.08::DOUBLE"), _GAPS),
    _row("integer", "shop.gaps.l_discount", _count("l_discount <> floor(l_discount)"), _GAPS),
    _row("relation", "shop.gaps.l_discount <= l_tax", _count("NOT (l_discount <= l_tax)"), _GAPS),
    _row("relation", "shop.gaps.l_tax <= l_discount", _count("NOT (l_tax <= l_discount)"), _GAPS),
    _row("unique", "shop.gaps.l_orderkey+l_tax", f"(SELECT count(*) - count(DISTINCT (l_orderkey, l_tax)) FROM {_GAPS})", "(SELECT 1)"),
]


def lines_with_nan(t):
    """Line items with NaN instead of some discounts and taxes."""
    nan = F.lit(float("nan"))
    return t.raw("lineitem").select(
        "l_orderkey", F.when(F.col("l_linenumber") == 3, nan).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_linenumber") == 5, nan).otherwise(F.col("l_tax")).alias("l_tax"),
    )


@query("check_nan_missing", "\nUNION ALL ".join(GAP_ROWS))
def check_nan_missing(t):
    return Q.validate_table(lines_with_nan(t), GAPS).select("check", "target", "status", "violations")


@query("profile_nan_missing", f"""
SELECT 'l_discount' AS "column", count(*) FILTER (l_discount IS NULL) AS null_count, min(l_discount) AS min_number, max(l_discount) AS max_number FROM {_GAPS}
UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax IS NULL), min(l_tax), max(l_tax) FROM {_GAPS}""")
def profile_nan_missing(t):
    return A.column_profile(lines_with_nan(t).drop("l_orderkey")).select("column", "null_count", "min_number", "max_number")


define("line_report", _union(LINE_ROWS))


@query("validate_table", with_ctes("line_report", "SELECT * FROM line_report"))
def validate_table(t):
    return line_report(t).select("check", "target", "status", "violations")


BUNDLE_LINE = {
    "dtype": LINE_ROWS["dtype"],
    "not_null": LINE_ROWS["not_null"][:-1],
    "range": LINE_ROWS["range"][:3],
    "allowed_values": LINE_ROWS["allowed_values"],
    "integer": LINE_ROWS["integer"][1:],
    "primary_key": LINE_ROWS["primary_key"],
    "foreign_key": LINE_ROWS["foreign_key"][:2],
}
BUNDLE_EVENT = {**EVENT_ROWS, "foreign_key": [_SKIP("foreign_key", "shop.event.user_id -> shop.customer.c_custkey")]}
ORDER_ROWS = {
    "dtype": [_row("dtype", f"shop.order.{c}", "0 * count(*)", "orders") for c in ("o_orderkey", "o_custkey", "o_totalprice")],
    "not_null": [_row("not_null", f"shop.order.{c}", _count(f"{c} IS NULL"), "orders") for c in ("o_orderkey", "o_custkey", "o_totalprice")],
    "range": [_row("range", "shop.order.o_totalprice", _count("o_totalprice < 0"), "orders")],
    "primary_key": [_row("primary_key", "shop.order.o_orderkey", _DUP("o_orderkey", "orders"), "(SELECT 1)")],
    "foreign_key": [_SKIP("foreign_key", "shop.order.o_custkey -> shop.customer.c_custkey")],
    "constraints": [_FAIL("constraints", "customer")],
}
PART_ROWS = {
    "dtype": [_row("dtype", f"shop.part.{c}", "0 * count(*)", "part") for c in ("p_partkey", "p_size")],
    "not_null": [_row("not_null", f"shop.part.{c}", _count(f"{c} IS NULL"), "part") for c in ("p_partkey", "p_size")],
    "range": [_row("range", "shop.part.p_size", _count("p_size < 1 OR p_size > 40"), "part")],
    "primary_key": [_row("primary_key", "shop.part.p_partkey", _DUP("p_partkey", "part"), "(SELECT 1)")],
}
define("bundle_report", _union(BUNDLE_LINE, BUNDLE_EVENT, ORDER_ROWS, PART_ROWS))


def bundle_report(t):
    constraints = {"line": (Integer("l_quantity"),), "customer": (NotNull("c_custkey"),)}
    return Q.validate_bundle(tables(t), constraints)


@query("validate_bundle", with_ctes("bundle_report", "SELECT * FROM bundle_report"))
def validate_bundle(t):
    return bundle_report(t).select("check", "target", "status", "violations")


@query(
    "report_passed",
    with_ctes("bundle_report", """SELECT bool_and(status <> 'failed') AS passed, CAST(count(*) FILTER (status = 'passed') AS BIGINT) AS checks_passed,
    CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS checks_failed, CAST(count(*) FILTER (status = 'skipped') AS BIGINT) AS checks_skipped FROM bundle_report"""),
)
def report_passed(t):
    return Q.report_passed(bundle_report(t))


@query("check_status_counts", with_ctes("line_report", "SELECT status, CAST(count(*) AS BIGINT) AS checks FROM line_report GROUP BY ALL"))
def check_status_counts(t):
    return Q.status_counts(line_report(t))
