"""Line deduplication against brute force, reversibility, the cuckoo filter, edge cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from stockweave.llm import linededup as L
from stockweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """``doc_id -> (lines, dropped, kept text)``; ids are distinct."""
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, (n, d, t) in brute(rows).items()}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in QUERIES["op4_line_references"](spark, SF).collect()}
    assert got == want and any(d for _, d, _ in want.values())


def test_keys_and_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(L, "KEYS_PER_FILTER", 5)
    monkeypatch.setattr(L, "ROWS_PER_TASK", 20)
    rng = random.Random(1)
    lines = [f"Shared line number {k} of some length" for k in range(40)] + ["\x1c" + "é" * 19, "é" * 19, "É" * 20, "short", "", "  padded shared line of words \t"]
    rows = [(i, "\n".join(rng.choice(lines).upper() if rng.random() < 0.3 else rng.choice(lines) for _ in range(12))) for i in range(60)]
    got = {r["doc_id"]: (r["line_dedup"]["n_lines"], r["line_dedup"]["n_dropped"], r["text"]) for r in L.dedup_lines(docs(rows)).collect()}
    assert got == brute(rows)


def test_deletion_undoes_insertion(spark, docs):
    line = "a line that is long enough to count"
    first, second = docs([(1, line), (2, line)]), docs([(3, line + "\nmore text that is long enough"), (4, line)])
    before = L.line_references(first)
    grown = L.insert_documents(before, second)
    assert [(r["n_docs"], r["keeper"]) for r in L.frequent_keys(grown).collect()] == [(4, 4)]
    assert [(r["n_docs"], r["keeper"]) for r in L.frequent_keys(L.delete_documents(grown, docs([(4, None)]))).collect()] == [(3, 3)]
    assert sorted(L.delete_documents(grown, second).collect()) == sorted(before.collect())


def test_filters_learn_and_forget(spark):
    keys = lambda lo, hi: spark.range(lo, hi).select(F.xxhash64("id").alias("hi"), F.xxhash64("id", F.lit(1)).alias("lo"))
    filters = L.update_filters(L.build_filters(keys(0, 400), 3), keys(400, 420), keys(0, 100), 3)
    tables = {r["shard"]: L.CuckooFilter.loads(r["filter"]) for r in filters.collect()}
    placed = keys(0, 420).withColumn("shard", L.shard_of(3)).collect()
    held = [bool(tables[r["shard"]].contains(np.array([r["hi"]]), np.array([r["lo"]]))[0]) for r in placed]
    assert all(held[100:]) and sum(held[:100]) < 5


def test_cuckoo_filter_has_no_false_negative_and_reports_when_full():
    rng = np.random.default_rng(2)
    hi, lo = (rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64) for _ in range(2))
    made = L.CuckooFilter.for_keys(3000)
    assert made.insert(hi, lo) and made.contains(hi, lo).all()
    made = L.CuckooFilter.loads(made.dumps())
    made.delete(hi[:1000], lo[:1000])
    assert made.contains(hi[1000:], lo[1000:]).all() and made.contains(hi[:1000], lo[:1000]).mean() < 0.02
    assert not L.CuckooFilter(4).insert(hi[:100], lo[:100])


def test_edge_cases(spark, docs, awkward):
    done = L.dedup_lines(awkward)
    assert done.columns == [*awkward.columns, "_line_dedup"] and done.count() == 8
    assert sorted(map(repr, done.select(*awkward.columns).collect())) == sorted(map(repr, awkward.collect()))
    assert L.dedup_lines(awkward.limit(0)).collect() == []
    line = "the very same line of some words"
    tied = L.dedup_lines(docs([(None, line), (7, line), (7, line), (8, line), (8, line)])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in tied) == [(0, ""), (7, ""), (7, ""), (8, line), (8, line)]


def test_repeated_ids_are_one_document(spark, docs):
    """As in the SQL statement: rows that share an id count once, and rows without an id count as one document."""
    import duckdb

    from stockweave.llm.queries import LINES_SQL

    line, other = "a line that is long enough to count", "another line that is long enough as well"
    rows = [(7, line), (7, line), (8, line + "\nshort"), (1, other), (2, other + "\n" + line[:10]), (3, other), (3, other)]
    own = duckdb.connect()
    own.register("documents", docs(rows).toPandas())
    want = {r[0]: r[1:] for r in own.sql(LINES_SQL).fetchall() if r[0] in (1, 2, 8)}
    done = L.dedup_lines(docs(rows)).collect()
    assert {r["doc_id"]: (r["line_dedup"]["n_lines"], r["line_dedup"]["n_dropped"]) for r in done if r["doc_id"] in want} == {k: v[:2] for k, v in want.items()}
    assert sorted(r["text"] for r in done if r["doc_id"] in (7, 8)) == sorted([line, line, line + "\nshort"])
    assert [r["text"] for r in done if r["doc_id"] == 1] == [""] and [r["text"] for r in done if r["doc_id"] == 3] == [other, other]


def test_a_full_filter_is_built_anew_from_the_exact_table(spark):
    import pytest
    from pyspark.errors import PySparkException

    rng = random.Random(6)
    keys = lambda n: [(rng.getrandbits(62), rng.getrandbits(62)) for _ in range(n)]
    few, many = keys(5), keys(4000)
    table = lambda rows: spark.createDataFrame(rows, "hi long, lo long")
    filters = L.build_filters(table(few), 1)
    with pytest.raises(PySparkException, match="is full"):
        L.update_filters(filters, table(many), table([]), 1).collect()
    grown = L.update_filters(filters, table(many), table(few[:2]), 1, table(few[2:] + many)).collect()
    held = L.CuckooFilter.loads(grown[0]["filter"])
    assert held.contains(*(np.array(c, np.int64) for c in zip(*(few[2:] + many)))).all()
