import numpy as np
import pytest
from pyspark.sql import functions as F
from stockweave.llm import neighbours
from stockweave.llm.queries import op13_bin_tree_neighbours

SF = "/root/testdata/sf0.01"
SHAPE = "vec_id long, embedding array<double>"


def brute(rows, asks, k=5):
    """Exact neighbours; equal vectors share one score."""
    some = [(i, np.asarray(v, dtype=np.float64)) for i, v in rows]
    out = {}
    for q, a in some:
        if q is not None and asks(q):
            scores = [(-float(round((a @ b) / np.sqrt((a @ a) * (b @ b)), 12)), i is None, i or 0) for i, b in some if i != q]
            out[q] = [(i if not null else None, -s) for s, null, i in sorted(set(scores))[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(got) + 1
        got.append((r["vec_id"], round(r["score"], 12)))
    return out


def test_query_recall_against_brute_force_on_the_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, want = answers(op13_bin_tree_neighbours(spark, SF)), brute(rows, lambda q: q % 50 == 0)
    assert got.keys() == want.keys() and all(len(got[q]) == 5 for q in want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
    vectors = dict(rows)
    for q, found in got.items():
        a = np.asarray(vectors[q], dtype=np.float64)
        for i, score in found:
            b = np.asarray(vectors[i], dtype=np.float64)
            assert score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-11)


def test_clustered_vectors_visit_few_leaves(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 12))
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=12)).tolist()) for i in range(4000)]
    used = []
    calibrate = neighbours.calibrate
    monkeypatch.setattr(neighbours, "calibrate", lambda tree, *a: used.append((calibrate(tree, *a), tree.n_leaves)) or used[-1][0])
    got = answers(neighbours.search(spark.createDataFrame(rows, SHAPE), F.col("vec_id") % 50 == 0, leaf_rows=50))
    want = brute(rows, lambda q: q % 50 == 0)
    visits, leaves = used[0]
    assert leaves >= 30 and visits <= leaves // 3
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_full_recall_is_exact_and_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(700)] + [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 2.0]) for i in range(300)]
    df = spark.createDataFrame(rows, SHAPE).repartition(6)
    want = brute(rows, lambda q: q % 50 == 0)
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    assert answers(neighbours.search(df, F.col("vec_id") % 50 == 0, recall=1.0, leaf_rows=100)) == want


def test_every_class_has_a_leaf_of_the_tree():
    rng = np.random.default_rng(2)
    for n, total in ((0, 0), (1, 1), (30, 30), (500, 500), (500, 50_000)):
        sample = neighbours.unit(rng.normal(size=(n, 5))) if n else np.zeros((0, 5))
        tree = neighbours.fit_tree(sample, total, leaf_rows=40)
        leaves = tree.assign(neighbours.unit(rng.normal(size=(200, 5))))
        assert 0 <= leaves.min() and leaves.max() < tree.n_leaves
        assert sorted(tree.walk(np.ones(5))) == list(range(tree.n_leaves))
    same = neighbours.fit_tree(np.tile([[1.0, 0.0]], (400, 1)), 400, leaf_rows=10)
    assert same.n_leaves == 1


def test_ties_copies_nulls_and_few_candidates(spark):
    rows = [(100, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (0, [0.0, 3.0])]
    bad = [(150, [0.0, 0.0]), (200, None), (250, [1.0, None]), (300, [float("nan"), 1.0]), (350, [float("inf"), 1.0]), (400, [1.0]), (450, []), (500, [-0.0, 0.0])]
    df = spark.createDataFrame(rows + bad, SHAPE).withColumns({c: F.lit("x") for c in ("id", "v", "key", "leaf", "score", "rank", "place")})
    got = answers(neighbours.search(df, F.col("vec_id") % 50 == 0))
    assert got == {
        100: [(3, 1.0), (4, 1.0), (50, 1.0), (None, 1.0), (0, 0.0)], 50: [(3, 1.0), (4, 1.0), (100, 1.0), (None, 1.0), (0, 0.0)],
        0: [(7, 1.0), (3, 0.0), (4, 0.0), (50, 0.0), (100, 0.0)],
    }


def test_empty_tables_and_lonely_queries(spark):
    for rows in ([], [(50, [1.0, 2.0])], [(50, None)], [(1, [1.0, 2.0]), (2, [2.0, 1.0])]):
        out = neighbours.search(spark.createDataFrame(rows, SHAPE), F.col("vec_id") % 50 == 0)
        assert out.collect() == [] and out.columns == ["query_id", "rank", "vec_id", "score"]
