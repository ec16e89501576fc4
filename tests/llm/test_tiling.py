"""Tiling: reordered passages, thresholds, blocks of items, edge cases."""

import random

import pytest

from stockweave.llm import tiling as G
from stockweave.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.01"


def words(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('klmnrst')}{rng.choice('aeiou')}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n)]


def brute_cover(doc, item, least):
    """Item words inside any run of ``least`` shared words (tiles of distinct words cannot overlap)."""
    runs = {tuple(doc[i : i + least]) for i in range(len(doc) - least + 1)}
    covered = set()
    for q in range(len(item) - least + 1):
        if tuple(item[q : q + least]) in runs:
            covered.update(range(q, q + least))
    return len(covered)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def test_query_catches_whole_passages(spark):
    found = QUERIES["op6_string_tiling"](spark, SF).collect()
    texts = {r["doc_id"]: G.word_list(r["text"]) for r in table(spark, SF, "documents").collect()}
    items = {r["item_id"]: G.word_list(r["text"]) for r in table(spark, SF, "benchmark").collect()}
    want = {(d, i) for d, t in texts.items() for i, w in items.items() if brute_cover(t, w, 5) >= 0.8 * len(w)}
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and want


def test_reordered_parts_and_small_edits_are_caught(spark, docs, items):
    item, other, noise = words(40, 1), words(40, 2), words(200, 3)
    reordered = noise[:30] + item[20:] + noise[30:50] + item[:20] + noise[50:]
    edited = noise[:20] + item[:12] + ["changed"] + item[13:] + noise[20:]
    half = noise[:20] + item[:20] + noise[20:]
    scattered = [w for pair in zip(item, noise) for w in pair]
    shouted = [w.upper() + "###" for w in item]
    rows = [(k, " ".join(t)) for k, t in enumerate((reordered, edited, half, scattered, shouted, noise))]
    got = {(r["doc_id"], r["item_id"]): (r["covered_words"], r["n_tiles"]) for r in G.contaminated(docs(rows), items([(1, " ".join(item)), (2, " ".join(other))])).collect()}
    assert got == {(0, 1): (40, 2), (1, 1): (39, 2), (4, 1): (40, 1)}


def test_tiles_never_overlap_and_repeats_count_once():
    doc, item = [1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 6, 7, 8]
    starts = [p for p in range(len(doc) - 2) if tuple(doc[p : p + 3]) in {tuple(item[q : q + 3]) for q in range(len(item) - 2)}]
    tiles = G.greedy_tiles(doc, item, starts, 3)
    assert sorted(tiles) == [(0, 5, 8), (8, 0, 5)]
    assert G.greedy_tiles([1] * 7, [1] * 20, list(range(5)), 3) and sum(n for _, _, n in G.greedy_tiles([1] * 7, [1] * 20, list(range(5)), 3)) <= 7


def test_blocks_of_items_give_the_same_result(spark, docs, items, monkeypatch):
    sets = [words(12, k) for k in range(12)]
    rows = [(k, " ".join(words(30, 50 + k) + s)) for k, s in enumerate(sets)]
    bench = items([(k, " ".join(s)) for k, s in enumerate(sets)])
    want = sorted(map(tuple, G.contaminated(docs(rows), bench).collect()))
    monkeypatch.setattr(G, "BLOCK_WORDS", 40)
    assert sorted(map(tuple, G.contaminated(docs(rows), bench).collect())) == want and len(want) == 12
    assert G.drop_contaminated(docs([*rows, (99, "clean text")]), bench).count() == 1


def test_edge_cases(spark, awkward, items):
    bench = items([(1, None), (2, ""), (3, "..."), (4, "a b c d e f"), (4, "a b c d e f"), (None, "One line of words here.\nAnd more."), (5, "word")])
    hits = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["covered_words"]) for r in G.contaminated(awkward, bench).collect())
    assert hits == [(0, 4, 6), (0, 4, 6), (4, 5, 1), (5, 0, 7), (5, 0, 7)]
    kept = G.drop_contaminated(awkward, bench)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 6]
    assert G.contaminated(awkward.limit(0), bench).collect() == [] and G.contaminated(awkward, bench.limit(0)).collect() == []


def test_numbers_and_short_items_both_ways(spark, docs, items):
    long = "A shop sells {} apples for {} coins and {} pears for {} coins each day"
    bench = items([(1, "12 + 7 = 19"), (2, "What is 12 * 7?"), (3, "+ - ="), (4, "big cat"), (5, long.format(3, 40, 5, 60)), (6, "3.14"), (7, " \n")])
    texts = {
        10: "so 12 + 7 = 19, as we know", 11: "so 12 + 7 = 190", 12: "12 + 8 = 19", 13: "12+7=19.5",
        20: "Quiz: what is 12 * 7?", 21: "what is 12 * 8?", 22: "what is love", 23: "What is 12 + 7?",
        30: "signs + - = here", 31: "signs + = -", 40: "one BIG cat", 41: "a cat so big", 42: "big cats", 43: "big, cat",
        50: "x " + long.format(3, 40, 5, 60), 51: "x " + long.format(4, 50, 6, 70), 60: "pi is 3.14.", 61: "pi is 3.141", 62: "3 14", 63: "13.14",
    }
    got = {(r["doc_id"], r["item_id"]) for r in G.contaminated(docs(list(texts.items())), bench).collect()}
    assert got == {(10, 1), (20, 2), (30, 3), (40, 4), (50, 5), (60, 6)}
    kept = {r["doc_id"] for r in G.drop_contaminated(docs(list(texts.items())), bench).collect()}
    assert kept == set(texts) - {d for d, _ in got}


def plain_tiles(doc, item, least):
    """The longest match of unmarked words, marked, again and again; ties by position."""
    free_doc, free_item, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and free_doc[p + n] and free_item[q + n] and doc[p + n] == item[q + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (p, q, n)
        if best is None:
            return tiles
        tiles.append(best)
        for k in range(best[2]):
            free_doc[best[0] + k] = free_item[best[1] + k] = False


def seeds(doc, item, least):
    windows = {tuple(item[q : q + least]) for q in range(len(item) - least + 1)}
    return [p for p in range(len(doc) - least + 1) if tuple(doc[p : p + least]) in windows]


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_tiles_equal_a_plain_search(letters):
    rng = random.Random(letters)
    for _ in range(120):
        doc, item = ([rng.randrange(letters) for _ in range(rng.randrange(0, 26))] for _ in range(2))
        least = rng.choice([2, 3, 5])
        assert G.greedy_tiles(doc, item, seeds(doc, item, least), least) == plain_tiles(doc, item, least)


def test_repetitive_pages_cost_little(spark, docs, items):
    """Equal words and short periods: matches grow with the sum of both lengths, not with their product."""
    import time

    started = time.time()
    for unit in (["same"], ["one", "two"], ["a", "b", "a"]):
        doc, item = (unit * 100_000)[:100_000], (unit * 1000)[:1000]
        found = G.Index([(7, " ".join(item))], 5, 0.8).hits(" ".join(doc))
        assert found == [(7, 1000, 1000, 1)]
    assert time.time() - started < 30


def test_blocks_are_taken_one_after_the_other(spark, docs, items, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_WORDS", 30)
    parts = [" ".join(words(12, k)) for k in range(20)]
    table = docs([(k, "start " + t + " end") for k, t in enumerate(parts)] + [(99, " ".join(words(50, 77))), (98, None), (5, "start " + parts[5] + " end")])
    benchmark = items([(k, t) for k, t in enumerate(parts) if k % 2])
    got = sorted((r["doc_id"], r["item_id"]) for r in G.contaminated(table, benchmark).collect())
    assert got == sorted([(k, k) for k in range(1, 20, 2)] + [(5, 5)])
    kept = G.drop_contaminated(table, benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*range(0, 20, 2), 98, 99]) and kept.columns == table.columns
