import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from stockweave.llm import turns
from stockweave.llm.queries import op12_turn_alignment

SF = "/root/testdata/sf0.001"
SHAPE = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def expected(rows):
    """Faults, and the cheapest edits by a plain search over row and place, of one conversation's rows in order."""
    seen, flags, blank, duplicate, truncated = set(), [], 0, 0, 0
    for _, role, text in rows:
        white = not re.search(r"[^\x20\x09-\x0D]", text)
        again = (role, text) in seen
        cut = not white and not again and re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?"
        seen.add((role, text))
        blank, duplicate, truncated = blank + white, duplicate + (again and not white), truncated + cut
        flags.append((white or again, cut))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {("", len(rows)): (0, ""), ("a", len(rows)): (0, "")}
    for i in range(len(rows), -1, -1):
        options = {p: [best[p, i]] if (p, i) in best else [] for p in ("", "s", "u", "a")}
        if i < len(rows):
            gone, cut = flags[i]
            for p in options:
                if (p, i + 1) in best:
                    cost, audit = best[p, i + 1]
                    options[p].append((cost + 2, "D" + audit))
                for (q, c), to in step.items():
                    if q == p and not gone and (to, i + 1) in best:
                        cost, audit = best[to, i + 1]
                        if initials[i] == c:
                            options[p].append((cost + 5 * cut, "K" + audit))
                        if c in "ua":
                            options[p].append((cost + 1 + 5 * cut, "R" + audit))
        for _ in range(4):  # insertions reach other places of the same row
            for p in options:
                for (q, c), to in step.items():
                    if q == p and c in "ua" and options[to]:
                        cost, audit = min(options[to])
                        options[p].append((cost + 5, "I" + audit))
        for p, found in options.items():
            if found:
                best[p, i] = min(found)
    cost, audit = best["", 0]
    lines, place, left = [], "", iter(rows)
    for edit in audit:
        _, role, text = next(left) if edit != "I" else (0, "", "")
        if edit == "D":
            continue
        role = role if edit == "K" else ("assistant" if place == "u" else "user")
        place = role[0]
        lines.append(f"{role}:{text}")
    assert GRAMMAR.fullmatch("".join(line[0] for line in lines))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def result(row):
    return tuple(row[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def test_query_equals_brute_force_on_the_whole_table(spark):
    table, convs = spark.read.parquet(f"{SF}/conversations.parquet").collect(), {}
    for r in table:
        rows = convs.setdefault(r["conv_id"], [])
        fault = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", r["text"]) if fault == 2 else r["text"]
        rows += [(r["turn"], "user" if fault == 4 else r["role"], text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    got = {r["conv_id"]: result(r) for r in op12_turn_alignment(spark, SF).collect()}
    assert got == {c: expected(in_order(rows)) for c, rows in convs.items()}


def made(rng, n):
    roles = ["user", "assistant", "system", "tool", "", "uma", " "]
    texts = ["a.", "b", " ", "c!", "", "long text?", "d. \t", "e \n", "a.", "f.", "g", "h?", "é."]
    return [(rng.choice([None, *range(n)]) if rng.random() < 0.2 else k, rng.choices(roles, [5, 5, 2, 1, 1, 1, 1])[0], rng.choice(texts)) for k in range(n)]


@pytest.mark.parametrize("block,long", [(16, 2048), (3, 2048), (2, 4)])
def test_blocks_and_long_conversations_equal_brute_force(spark, monkeypatch, block, long):
    rng = random.Random(block)
    convs = {c: in_order(made(rng, rng.choice([0, 1, 2, 3, 5, 8, 13, 21]))) for c in range(60)}
    convs[None] = in_order(made(rng, 30))
    rows = [(c, *r) for c, group in convs.items() for r in group]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SHAPE)
    monkeypatch.setattr(turns, "BLOCK", block)  # forked workers may hold the module already: blocks of the driver's own run below
    got = {r["conv_id"]: result(r) for r in turns.repair(df, long=long).collect()}
    assert got == {c: expected(group) for c, group in convs.items() if group}
    for group in convs.values():
        counts, paths, seen = turns.Counts(), turns.Paths(), set()
        for t, role, text in group:
            paths.add(counts.add(t, role, text, (role, text) in seen))
            seen.add((role, text))
        assert paths.finish() == expected(group)[5:7]


def test_band_drops_nothing():
    rng = random.Random(1)
    for _ in range(300):
        rows = tuple((rng.choice("sua"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 7)))
        target = rng.choice(["", "ua", "sua", "uaua", "suaua", "auau", "a"])
        whole = turns.align(rows, target, 10**6)
        assert whole is None or turns.align(rows, target, whole[0]) == whole and turns.align(rows, target, whole[0] - 1) is None


def test_nulls_empty_tables_and_conversations_without_rows(spark):
    rows = [(1, None, None, None), (1, 3, "user", "Hi."), (2, 0, "user", "x " * 200_000), (2, 1, "assistant", "Yes."), (None, None, "user", "Hi."), (None, 1, "assistant", "Ok.")]
    df = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("x") for c in ("c", "t", "r", "x", "here", "audit", "cost", "big")})
    got = {r["conv_id"]: r for r in turns.repair(df).collect()}
    assert result(got[1])[:6] == (0, 1, 0, 0, 1, 4) and got[1]["audit"] == "DD"
    assert got[2]["truncated"] == 1 and got[2]["audit"] == "DD" and got[None]["audit"] == "KK"
    nothing = turns.repair(df, F.lit(None).cast("boolean")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["conv_id"], *result(r)) for r in nothing} == {(c, 0, 0, 0, 0, 0, 0, "", empty) for c in (1, 2, None)}
    assert turns.repair(spark.createDataFrame([], SHAPE)).collect() == []
    assert turns.damage(spark.createDataFrame([(None, None, None, None)], SHAPE)).count() == 1
