"""Hash tree: shares by weight, confined movement, gapless slots, edge cases."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from stockweave.llm import sharding
from stockweave.llm.queries import FLEET, QUERIES

SF = "/root/testdata/sf0.001"


def shards(spark, tree, n=4000):
    return {r[0]: r[1] for r in sharding.place(spark.range(n), F.col("id"), tree).collect()}


def test_growth_takes_rows_only_into_the_new_shard(spark):
    before, after = shards(spark, FLEET), shards(spark, sharding.grow(FLEET))
    moved = {k for k in before if before[k] != after[k]}
    assert moved and {after[k] for k in moved} == {24}
    assert abs(len(moved) / len(before) - 1 / 25) < 0.015


def test_a_shard_in_a_rack_moves_keys_into_its_region_only(spark):
    tree = sharding.add_shard(FLEET, "r1k0")
    region = {leaf.shard: leaf.region for leaf in tree}
    before, after = shards(spark, FLEET), shards(spark, tree)
    moved = [k for k in before if before[k] != after[k]]
    assert moved and {region[after[k]] for k in moved} == {"r1"}


def test_weights_give_shares_and_zero_takes_nothing(spark):
    tree = [sharding.Leaf("a", "a0", 0, 3.0), sharding.Leaf("a", "a1", 1, 1.0), sharding.Leaf("b", "b0", 2, 4.0), sharding.Leaf("b", "b0", 3, 0.0)]
    found = Counter(shards(spark, tree, 8000).values())
    assert set(found) == {0, 1, 2}
    for shard, share in ((0, 3 / 8), (1, 1 / 8), (2, 1 / 2)):
        assert abs(found[shard] / 8000 - share) < 0.02


def test_slots_are_gapless_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOTS_PER_BUCKET", 10)
    placed = sharding.place(spark.range(900), F.col("id"), sharding.build_tree(2, 1, 2))
    rows = sharding.assign_slots(placed, ["id"], 900).collect()
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_query_and_edge_cases(spark, awkward, tmp_path):
    for part in ("empty", "all"):
        root = tmp_path / part
        (awkward.limit(0) if part == "empty" else awkward).write.parquet(f"{root}/documents.parquet")
        rows = QUERIES["op1_shard_tree"](spark, str(root)).collect()
        assert len(rows) == (0 if part == "empty" else 8)
    by_id = {r["doc_id"]: r for r in rows}
    assert (by_id[1]["size"], by_id[1]["text_crc32"]) == (8, 0)
    assert (by_id[6]["size"], by_id[6]["text_crc32"]) == (88, zlib.crc32(("é" * 40).encode()))
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def descend(key, tree):
    """The tree in plain Python: at every node the child of the smallest draw."""
    import hashlib
    import math

    def weight(leaves):
        return sum(leaf.weight for leaf in leaves)

    def choose(leaves, name):
        groups = {}
        for leaf in leaves:
            if leaf.weight > 0:
                groups.setdefault(name(leaf), []).append(leaf)
        draw = lambda n: (int(hashlib.md5(f"{key}|{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return groups[min(groups, key=lambda n: (-math.log(draw(n)) / weight(groups[n]), n))]

    leaves = choose(choose(tree, lambda leaf: leaf.region), lambda leaf: leaf.rack)
    return choose(leaves, lambda leaf: f"s{leaf.shard}")[0].shard


def test_query_equals_a_plain_descent_on_the_whole_table(spark):
    rows = QUERIES["op1_shard_tree"](spark, SF).collect()
    bigger = sharding.grow(FLEET)
    assert rows and all((r["shard"], r["grown_shard"]) == (descend(r["doc_id"], FLEET), descend(r["doc_id"], bigger)) for r in rows)
    uneven = [sharding.Leaf("a", "a0", 0, 2.5), sharding.Leaf("a", "a1", 1, 0.5), sharding.Leaf("b", "b0", 2, 1.5), sharding.Leaf("b", "b0", 3, 0.0), sharding.Leaf("c", "c0", 4, 4.0)]
    assert shards(spark, uneven, 800) == {k: descend(k, uneven) for k in range(800)}


def test_slots_leave_columns_of_any_name_alone(spark):
    df = spark.range(500).withColumns({c: F.lit("x") for c in ("_bucket", "_at", "_shard", "_b", "_start")})
    out = sharding.assign_slots(sharding.place(df, F.col("id"), FLEET), ["id"], 500)
    assert out.columns == [*df.columns, "shard", "slot"] and out.where("_bucket = 'x' AND _at = 'x' AND _shard = 'x' AND _b = 'x' AND _start = 'x'").count() == 500
