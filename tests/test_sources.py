"""Typed ingestion, verified storage, registry and the retail model build."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stockweave.operators.fingerprint import content_fingerprint, fingerprint_text
from stockweave.schema import CANONICAL, FieldSpec, TableSpec
from stockweave.sources import files, registry, retail

SALES = TableSpec(
    "test.sales",
    (FieldSpec("date", "date"), FieldSpec("product_id", "str"), FieldSpec("quantity", "int", min=0),
     FieldSpec("unit_price", "float", nullable=True, min=0.01), FieldSpec("channel", "category", allowed_values=("store", "online"))),
    primary_key=("date", "product_id"),
)
TEXT = "date,product_id,quantity,unit_price,channel\n2024-01-01,A,3,1.5,store\n2024-01-01,B,0,,online\n2024-01-02,A,5.0,2.25,store\n2024-01-02,B,1,NA,online\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_typed_csv(spark, tmp_path):
    df = files.load_table(spark, write(tmp_path / "sales.csv", TEXT), SALES)
    rows = sorted(tuple(r) for r in df.collect())
    assert rows[0] == (dt.date(2024, 1, 1), "A", 3, 1.5, "store")
    assert [r[2] for r in rows] == [3, 0, 5, 1] and rows[3][3] is None


def test_bad_values_are_reported_together(spark, tmp_path):
    bad = TEXT.replace("A,3,", "A,3.5,").replace("B,0,", "B,many,").replace("2024-01-02,B", "yesterday,B")
    with pytest.raises(files.IngestionError, match=r"'date': 1 bad.*'quantity': 2 bad, e\.g\. \['3\.5', 'many'\]"):
        files.load_table(spark, write(tmp_path / "bad.csv", bad), SALES)
    lazy = files.read_csv_typed(spark, str(tmp_path / "bad.csv"), SALES, audit=False)
    with pytest.raises(PySparkException):
        lazy.collect()


def test_columns_must_match(spark, tmp_path):
    with pytest.raises(files.IngestionError, match="missing \\['channel'\\]"):
        files.load_table(spark, write(tmp_path / "short.csv", "date,product_id,quantity,unit_price\n"), SALES)
    with pytest.raises(files.IngestionError, match="unsupported format"):
        files.load_table(spark, str(tmp_path / "x.json"), SALES)


def test_booleans_and_large_integers(spark):
    spec = TableSpec("t.flags", (FieldSpec("flag", "bool", nullable=True), FieldSpec("n", "int", nullable=True)))
    text = spark.createDataFrame([(" Yes ", "9007199254740993"), ("F", "1e3"), ("0", "-7.0"), (None, None)], "flag string, n string")
    assert [tuple(r) for r in files.type_text(text, spec).collect()] == [(True, 9007199254740993), (False, 1000), (False, -7), (None, None)]


def test_fingerprint_ignores_order_but_not_content(spark):
    a = spark.createDataFrame([(1, "x", 1.5), (2, None, 2.5), (2, None, 2.5)], "k bigint, s string, v double")
    b = a.orderBy(F.desc("k")).select("v", "s", "k").repartition(5)
    same = [content_fingerprint(x).first()["fingerprint"] for x in (a, b)]
    assert same[0] == same[1]
    for other in (a.dropDuplicates(), a.withColumn("v", F.col("v") + 1), a.na.fill("n"), a.na.fill("")):
        assert content_fingerprint(other).first()["fingerprint"] != same[0]
    assert fingerprint_text(a, 0, None) == content_fingerprint(a.limit(0)).first()["fingerprint"]


def test_registry_round_trip(spark, tmp_path):
    root, spec = str(tmp_path / "lake"), CANONICAL["retail.region"]
    first = spark.createDataFrame([("CA", "California")], "region_id string, name string")
    registry.register_table(first, spec, "region", "1.0.0", "reference", root)
    with pytest.raises(registry.DuplicateDataset):
        registry.register_table(first, spec, "region", "1.0.0", "reference", root)
    second = first.union(spark.createDataFrame([("TX", "Texas")], "region_id string, name string"))
    registry.register_table(second, spec, "region", "1.1.0", "derived", root)
    entries = registry.list_entries(registry.read_registry(spark, f"{root}/registry")).collect()
    assert [(e["seq"], e["version"], e["row_count"]) for e in entries] == [(1, "1.0.0", 1), (2, "1.1.0", 2)]
    assert registry.load_registered(spark, root, "region").count() == 2
    assert registry.load_registered(spark, root, "region", "1.0.0").count() == 1
    first.write.mode("append").parquet(f"{root}/region/1.1.0")
    with pytest.raises(files.IngestionError, match="does not match"):
        registry.load_registered(spark, root, "region")


CALENDAR = "date,wm_yr_wk,weekday,wday,month,year,d,event_name_1,event_type_1,event_name_2,event_type_2,snap_CA,snap_TX\n" + "\n".join(
    f"2011-{1 if i < 3 else 2:02d}-{29 + i if i < 3 else i - 2:02d},11101,x,{i % 7 + 1},{1 if i < 3 else 2},2011,d_{i + 1},"
    + ("Feast,Cultural,Fair,National," if i == 4 else ",,,,") + f"{int(i < 2)},{int(i % 2 == 0)}"
    for i in range(9)
) + "\n"
WIDE = "id,item_id,dept_id,cat_id,store_id,state_id," + ",".join(f"d_{i + 1}" for i in range(9)) + "\n" + "".join(
    f"{i}_{s},{i},{i[:3]},{i[0]},{s},{s[:2]}," + ",".join(str((k * 3 + len(i) + n) % 5) for k in range(9)) + "\n"
    for n, i in enumerate(("FOO_1", "FOO_2", "HOB_1")) for s in ("CA_1", "TX_1")
)
PRICES = "store_id,item_id,wm_yr_wk,sell_price\nCA_1,FOO_1,11101,2.5\nTX_1,HOB_1,11101,3.0\nWI_1,FOO_1,11101,9.9\n"


@pytest.fixture
def source(tmp_path):
    write(tmp_path / "calendar.csv", CALENDAR)
    write(tmp_path / "sales_train_validation.csv", WIDE)
    write(tmp_path / "sell_prices.csv", PRICES)
    return tmp_path


def test_retail_bundle(spark, source):
    from stockweave.operators.quality import report_passed, validate_bundle

    tables = retail.load_retail(spark, str(source))
    counts = {name: df.count() for name, df in tables.items()}
    assert counts == {"region": 2, "store": 2, "category": 2, "department": 2, "product": 3, "calendar": 9, "calendar_event": 2,
                      "calendar_snap": 18, "sales": 54, "price": 2}
    assert tables["calendar"].where("date = '2011-01-29'").first()["weekday"] == 6
    assert {r["name"] for r in tables["region"].collect()} == {"California", "Texas"}
    report = validate_bundle({n: (CANONICAL[f"retail.{n}"], df) for n, df in tables.items()})
    assert report_passed(report).first()["passed"] is True


def test_source_errors(spark, source):
    write(source / "calendar.csv", CALENDAR.replace(",x,1,1,", ",x,2,1,", 1))
    with pytest.raises(PySparkException, match="weekday does not match"):
        retail.load_retail(spark, str(source))["calendar"].collect()
    write(source / "calendar.csv", "\n".join(CALENDAR.splitlines()[:-1]) + "\n")
    with pytest.raises(files.IngestionError, match="d_9"):
        retail.load_retail(spark, str(source))


def test_subset(spark, source):
    wide = retail.read_wide_sales(spark, f"{source}/sales_train_validation.csv")
    prices = spark.read.option("header", True).csv(f"{source}/sell_prices.csv")
    rows, kept = retail.extract_subset(wide, prices, stores=["CA_1"], top=1)
    totals = {r["item_id"]: r["t"] for r in wide.where("store_id = 'CA_1'").select("item_id", retail.row_total(retail.day_columns(wide)).alias("t")).collect()}
    best = min(totals, key=lambda i: (-totals[i], i))
    assert [r["item_id"] for r in rows.collect()] == [best]
    assert {r["store_id"] for r in kept.collect()} <= {"CA_1"}
    with pytest.raises(ValueError):
        retail.extract_subset(wide, prices, top=0)


def test_sales_file_preference(spark, source):
    assert retail.find_sales_file(spark, str(source)).endswith("validation.csv")
    write(source / "sales_train_evaluation.csv", WIDE)
    assert retail.find_sales_file(spark, str(source)).endswith("evaluation.csv")


def test_ingestion_sets_bad_rows_aside(spark, tmp_path):
    """Good rows typed, bad rows as read, and a report equal to an audit of the whole text."""
    bad = TEXT.replace("A,3,", "A,3.5,").replace("2024-01-02,B", "yesterday,B") + "2024-01-03,C,x,oops,store\n2024-01-03,C,x,,online\n"
    path = write(tmp_path / "mixed.csv", bad)
    found = files.ingest_csv(spark, path, SALES)
    assert sorted(tuple(r) for r in found.rows.collect()) == [(dt.date(2024, 1, 1), "B", 0, None, "online"), (dt.date(2024, 1, 2), "A", 5, 2.25, "store")]
    assert found.rows.schema.simpleString() == files.type_text(files.read_csv_text(spark, path, SALES), SALES).schema.simpleString()
    assert sorted(r["quantity"] for r in found.rejected.collect()) == ["1", "3.5", "x", "x"]
    whole = files.bad_value_audit(files.read_csv_text(spark, path, SALES), SALES)
    assert {tuple(map(str, r)) for r in found.report.collect()} == {tuple(map(str, r)) for r in whole.collect()}
    empty = files.ingest_csv(spark, write(tmp_path / "empty.csv", TEXT.splitlines()[0] + "\n"), SALES)
    assert empty.rows.collect() == [] and empty.rejected.collect() == [] and {r["bad_count"] for r in empty.report.collect()} == {0}


def test_day_labels_with_and_without_gaps(spark):
    wide = spark.createDataFrame([("a", 1, 2, 3)], "item_id string, d_5 long, d_6 long, d_7 long")
    whole = retail.unpivot_days(wide, ["item_id"])
    assert [tuple(r) for r in whole.orderBy("d").collect()] == [("a", "d_5", 1), ("a", "d_6", 2), ("a", "d_7", 3)]
    gaps = retail.unpivot_days(wide.withColumnRenamed("d_6", "d_x"), ["item_id"])
    assert {(r["d"], r["quantity"]) for r in gaps.collect()} == {("d_5", 1), ("d_x", 2), ("d_7", 3)} and gaps.schema == whole.schema


def test_purchase_orders_are_shared_by_more_tasks_when_lines_grow(spark, tmp_path, monkeypatch):
    from stockweave.sources import drivertables as D

    def table(name, rows):
        spark.createDataFrame(rows, D.SCHEMAS[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    when = dt.datetime(2024, 1, 5)
    line = lambda o, n, q: (o, o % 3, o % 2, n, float(q), 1.0, 0.0, 0.0, "N", "O", when)
    # Every line twice, one without an order key, one whose order is missing; order 7 stands on two days.
    table("lineitem", [line(o, n, 2) for o in range(1000) for n in (1, 1, 2, 2)] + [(None, 1, 1, 1, 9.0, 1.0, 0.0, 0.0, "N", "O", when), line(5000, 1, 9)])
    table("orders", [(o, 1, "O", 1.0, when, "x") for o in range(1000)] + [(7, 1, "O", 1.0, when + dt.timedelta(days=1), "x")])
    table("part", [(p, "n", "b", f"T{p}", 1, 1.0) for p in range(3)])
    table("supplier", [(s, "n", 0, 1.0) for s in range(2)])
    table("nation", [(0, "n", 0)])
    table("region", [(0, "ASIA")])
    monkeypatch.setattr(D, "ORDER_ROWS", 200)
    orders = D.DriverTables(spark, str(tmp_path)).purchase_orders
    rows = orders.withColumn("task", F.spark_partition_id()).collect()
    got = sorted((r["po_id"], r["product_id"], r["warehouse_id"], r["supplier_id"], r["order_date"], r["quantity"]) for r in rows)
    days = lambda o: [when.date(), when.date() + dt.timedelta(days=1)] if o == 7 else [when.date()]
    assert got == sorted((f"{o}-{n}-{o % 3}-{o % 2}", f"T{o % 3}", "ASIA", o % 2, d, 4) for o in range(1000) for n in (1, 2) for d in days(o))
    held = [sum(r["task"] == t for r in rows) for t in {r["task"] for r in rows}]
    assert len(held) == 21 and max(held) < 300


def test_regions_do_not_gather_the_lines_of_a_shuffled_join(spark, tmp_path):
    from stockweave.sources import drivertables as D

    def table(name, rows):
        spark.createDataFrame(rows, D.SCHEMAS[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    when = dt.datetime(2024, 1, 5)
    # Suppliers 0 to 39 of one nation, 40 without a nation, 41 of a nation that is missing; every line is there twice.
    lines = [(o, o % 3, o % 42, 1, 2.0, 1.0, 0.0, 0.0, "N", "O", when) for o in range(420)] * 2 + [(1, 1, None, 2, 2.0, 1.0, 0.0, 0.0, "N", "O", when)]
    table("lineitem", lines)
    table("orders", [(o, 1, "O", 1.0, when, "x") for o in range(420)])
    table("part", [(p, "n", "b", f"T{p}", 1, 1.0) for p in range(3)])
    table("supplier", [(s, "n", 0, 1.0) for s in range(40)] + [(40, "n", None, 1.0), (41, "n", 9, 1.0)])
    table("nation", [(0, "n", 0), (None, "m", 0)])
    table("region", [(0, "ASIA")])
    alone = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in alone}
    try:
        for k, v in alone.items():
            spark.conf.set(k, v)
        rows = D.DriverTables(spark, str(tmp_path)).purchase_orders.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = sorted((r["po_id"], r["product_id"], r["warehouse_id"], r["supplier_id"], r["quantity"]) for r in rows)
    assert got == sorted((f"{o}-1-{o % 3}-{o % 42}", f"T{o % 3}", "ASIA", o % 42, 4) for o in range(420) if o % 42 < 40)
    assert len({r["task"] for r in rows}) > 1


@pytest.mark.parametrize("short", [0, 500_000])
def test_lines_are_not_sorted_for_the_tables_they_are_joined_with(spark, tmp_path, monkeypatch, capsys, short):
    """Orders, parts, suppliers and lead times are hashed in shares where they are long and sent whole where they are short."""
    from stockweave.queries.ledger import timed_orders
    from stockweave.sources import drivertables as D

    def table(name, rows):
        spark.createDataFrame(rows, D.SCHEMAS[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    day = lambda n: dt.datetime(2024, 1, 5) + dt.timedelta(days=n)
    line = lambda o, p, s: (o, p, s, 1, 2.0, 1.0, 0.0, 0.0, "N", "O", day(o % 5 + 1))
    # Every line twice; keys that are null or found nowhere; part 2 and supplier 1 stand twice, order 7 on two days.
    table("lineitem", [line(o, o % 3, o % 2) for o in range(300)] * 2 + [line(o, p, s) for o, p, s in ((1, None, 1), (1, 1, None), (1, 9, 1), (1, 1, 9), (900, 1, 1))] + [(None, 1, 1, 1, 2.0, 1.0, 0.0, 0.0, "N", "O", day(1))])
    table("orders", [(o, 1, "O", 1.0, day(0), "x") for o in range(300)] + [(7, 1, "O", 1.0, day(1), "x"), (None, 1, "O", 1.0, day(0), "x")])
    table("part", [(p, "n", "b", f"T{p}", 1, 1.0) for p in (0, 1, 2, 2, None)])
    table("supplier", [(s, "n", 0, 1.0) for s in (0, 1, 1, None)])
    table("nation", [(0, "n", 0)])
    table("region", [(0, "ASIA")])
    monkeypatch.setattr(D, "BROADCAST_ROWS", short)
    monkeypatch.setattr(D, "ORDER_ROWS", 20)
    alone = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in alone}
    try:
        for k, v in alone.items():
            spark.conf.set(k, v)
        t = D.DriverTables(spark, str(tmp_path))
        frames = {"orders": timed_orders(t), "moves": t.stock_moves, "demand": t.order_demand, "sales": t.sales}
        rows = {k: df.collect() for k, df in frames.items()}
        capsys.readouterr()
        for name, df in frames.items():
            df.explain()
            plan = capsys.readouterr().out
            assert "SortMergeJoin" not in plan, name
            assert ("ShuffledHashJoin" in plan) is (short == 0), name
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # Rows of a line's key in parts, in suppliers, and the days of its order.
    joined = [(o, o % 3, o % 2, d) for o in range(300) for d in ((0, 1) if o == 7 else (0,)) for _ in range((1 + (o % 3 == 2)) * (1 + o % 2))]
    got = sorted((r["po_id"], r["product_id"], r["warehouse_id"], r["order_date"], r["quantity"]) for r in rows["orders"])
    assert got == sorted((f"{o}-1-{p}-{s}", f"T{p}", "ASIA", day(d).date(), 4) for o, p, s, d in joined for _ in range(1 + s))  # lead times per supplier row
    demand, arrivals = {}, {}
    for o, p, s, d in joined:
        demand[day(d).date(), f"T{p}"] = demand.get((day(d).date(), f"T{p}"), 0) + 4
        arrivals[day(o % 5 + 1).date(), f"T{p}"] = arrivals.get((day(o % 5 + 1).date(), f"T{p}"), 0) + 4
    assert {(r["date"], r["product_id"]): r["demand"] for r in rows["demand"]} == demand
    assert {(r["date"], r["product_id"]): (r["arrivals"], r["demand"]) for r in rows["moves"]} == {k: (arrivals.get(k, 0), demand.get(k, 0)) for k in arrivals | demand}
