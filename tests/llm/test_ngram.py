"""Scores against SQL and against a plain trigram count; blocks, parts, edge cases."""

import math
from collections import Counter

import duckdb
import numpy as np

from stockweave.llm import ngram as N
from stockweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def plain(texts, order):
    words = [(t or "").encode().lower().split() for t in texts]
    grams = lambda w, n: [tuple(w[i - n + 1 : i + 1]) for i in range(n - 1, len(w))]
    every = [Counter(g for w in words for g in grams(w, n)) for n in range(1, order + 1)]
    total = sum(map(len, words))
    out = []
    for w in words:
        own = [Counter(grams(w, n)) for n in range(1, order + 1)]
        count = lambda g: every[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: E731, B023
        bare, score = 0, 0
        for i in range(len(w)):
            for n in range(order, 1, -1):
                g = tuple(w[i - n + 1 : i + 1]) if i >= n - 1 else None
                if g and count(g) > 0:
                    value = math.log(count(g) / count(g[:-1])) + (order - n) * math.log(0.4)
                    break
            else:
                value, bare = math.log(max(count((w[i],)), 0.5) / total) + (order - 1) * math.log(0.4), bare + 1
            score += round(value * 1e6)
        out.append((len(w), bare, score))
    return out


def test_query_equals_sql(spark):
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    want = sorted(duckdb.sql(ORACLES["op7_stupid_backoff"]).fetchall())
    frame = QUERIES["op7_stupid_backoff"](spark, SF)
    assert sorted(map(tuple, frame.select("doc_id", "n_words", "n_without_context", "score_micro").collect())) == want


def test_trigrams_over_many_blocks_and_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_BYTES", 300)
    monkeypatch.setattr(N, "KEYS_PER_PART", 30)
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdeF"), int(rng.integers(0, 40)))) for _ in range(60)] + [None, "", "a b c", "a b c"]
    got = {r["doc_id"]: tuple(r)[1:] for r in N.score_documents(docs(list(enumerate(texts))), order=3).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, 3)


def test_trigram_query_equals_sql_and_comes_first(spark):
    assert next(name for name in QUERIES if name.startswith("op7_")) == "op7_stupid_backoff_trigrams"
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    want = sorted(duckdb.sql(ORACLES["op7_stupid_backoff_trigrams"]).fetchall())
    frame = QUERIES["op7_stupid_backoff_trigrams"](spark, SF)
    assert sorted(map(tuple, frame.select("doc_id", "n_words", "n_without_context", "score_micro").collect())) == want
    assert want != sorted(duckdb.sql(ORACLES["op7_stupid_backoff"]).fetchall())


def test_packing_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert np.array_equal(N.unpack_sorted(N.pack_sorted(keys)), keys) and len(N.unpack_sorted(N.pack_sorted(keys[:0]))) == 0


def test_edge_cases(spark, awkward):
    rows = sorted(((r["doc_id"] or 0, r["n_words"], r["score_micro"]) for r in N.score_documents(awkward).collect()))
    assert [r[:2] for r in rows] == [(0, 6), (1, 0), (2, 0), (3, 0), (4, 30_000), (5, 7), (5, 7), (6, 1)]
    assert rows[1][2] == 0 and N.score_documents(awkward.limit(0)).collect() == []
