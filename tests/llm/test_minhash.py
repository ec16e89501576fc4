"""Near-duplicates against an exact comparison of all pairs, components, edge cases."""

import random

import pytest

from stockweave.llm import minhash as M
from stockweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, size, percent):
    """``doc_id -> (set size, smallest id reachable)`` by comparing all pairs."""
    sets, parent = {}, {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a]) < percent * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


def test_query_equals_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    frame = QUERIES["op8_minhash_components"](spark, SF).cache()
    want = brute(rows, 4, 80)
    assert result(frame) == want
    assert {r["doc_id"] for r in frame.collect() if r["kept"]} == {i for i, (_, c) in want.items() if i == c}


def family(rng, n, base, heavy):
    """Copies of one text with some to many words replaced: links, chains and strangers in the same buckets."""
    out = []
    for _ in range(n):
        words = base[:]
        for _ in range(rng.randrange(heavy)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10_000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("size", [4, 5])
def test_families_with_chains_and_strangers(spark, docs, size):
    rng = random.Random(size)
    texts = []
    for f in range(3):
        base = [f"w{f}x{k}" for k in range(80)]
        texts += family(rng, 60, base, 9)
        chain = base[:]
        for k in range(0, 40, 2):  # each like the one before, the ends unlike each other
            chain = chain[:]
            chain[k] = f"link{f}-{k}"
            texts.append(" ".join(chain))
    texts += [texts[0]] * 20 + ["One two", "one TWO", "one two three", "", None]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert result(M.near_duplicates(docs(rows), size=size)) == brute(rows, size, 80)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["component"] for r in M.components(frame).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 130)}, **{k: 200 for k in (200, 201, 202)}}
    assert M.components(frame.limit(0)).collect() == []


def test_drop_duplicates_and_edge_cases(spark, docs, awkward):
    text = " ".join(f"w{k}" for k in range(30))
    kept = M.drop_duplicates(docs([(5, text), (3, text + " more"), (9, text.upper()), (4, None), (8, ""), (7, "other words entirely")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 7, 8]
    same = M.drop_duplicates(awkward)
    assert same.columns == awkward.columns and same.count() == 8
    assert M.near_duplicates(awkward.limit(0)).collect() == []
    found = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in M.near_duplicates(awkward).collect()))
    assert found == [(0, 2, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 3, 5), (5, 3, 5), (6, 1, 6)]


def test_clean_rows_that_share_an_id_with_a_copy_stay(spark, docs):
    text, other = (" ".join(f"{w}{k}" for k in range(30)) for w in ("w", "v"))
    rows = [(3, text), (None, text.upper()), (None, "a clean document without an id"), (None, other), (None, other + " end"),
            (8, text + " more"), (8, "another clean document under id eight"), (9, "same words here"), (9, "Same WORDS here"), (9, "quite different words")]
    kept = [(r["doc_id"], r["text"]) for r in M.drop_duplicates(docs(rows)).collect()]
    again = [(r["doc_id"], r["text"]) for r in M.drop_duplicates(docs(rows[::-1])).collect()]
    assert sorted(kept, key=str) == sorted(again, key=str) and len(kept) == 6
    assert {rows[0], rows[2], rows[6], rows[9]} <= set(kept)
    assert len({rows[3], rows[4]} & set(kept)) == 1 and len({rows[7], rows[8]} & set(kept)) == 1
