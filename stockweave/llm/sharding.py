"""Sharding by a hierarchical weighted hash tree.

Region, rack and shard are chosen level by level. At each node every child draws ``-ln(u) / weight`` with ``u`` hashed
from the key and the child's name, and the smallest draw wins, so a child gets its share by weight. A node's weight
is the sum of its shards' weights. Draws do not depend on each other: when the weights of a subtree change, keys only
move into or out of the children whose weights changed. ``grow`` adds a shard as a region of its own, so all that
moves goes straight into the new shard; a shard added inside a rack (``add_shard``) moves keys into its region only,
where they settle by the same draws.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockweave.llm.frames import fresh

SLOTS_PER_BUCKET = 200_000


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def build_tree(regions: int, racks: int, shards: int) -> list[Leaf]:
    """Equal weights; shard numbers from 0."""
    return [Leaf(f"r{g}", f"r{g}k{k}", (g * racks + k) * shards + s) for g in range(regions) for k in range(racks) for s in range(shards)]


def grow(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard as a new region: only keys that move into it move at all."""
    n, region = max(leaf.shard for leaf in tree) + 1, len({leaf.region for leaf in tree})
    return [*tree, Leaf(f"r{region}", f"r{region}k0", n, weight)]


def add_shard(tree: Sequence[Leaf], rack: str, weight: float = 1.0) -> list[Leaf]:
    """One more shard inside a rack: keys move within and into that rack's region alone."""
    region = next(leaf.region for leaf in tree if leaf.rack == rack)
    return [*tree, Leaf(region, rack, max(leaf.shard for leaf in tree) + 1, weight)]


def unit_draw(key: Column, name: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of MD5 of ``key|name``."""
    digits = F.substring(F.md5(F.concat(key, F.lit("|"), name).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _children(tree: Sequence[Leaf], parent: str, level: str) -> Column:
    """A literal map: a node's name to its children's names and weights."""
    found: dict[str, dict[str, float]] = {}
    for leaf in tree:
        if leaf.weight > 0:
            node = found.setdefault(getattr(leaf, parent) if parent else "", {})
            name = f"s{leaf.shard}" if level == "shard" else getattr(leaf, level)
            node[name] = node.get(name, 0.0) + leaf.weight
    entries = []
    for node, below in sorted(found.items()):
        entries += [F.lit(node), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in sorted(below.items())])]
    return F.create_map(*entries)


def place(df: DataFrame, key: Column, tree: Sequence[Leaf], name: str = "shard") -> DataFrame:
    """Add ``name`` (int), replacing a column called so: the key's shard. A null key is placed as the empty text."""
    if not any(leaf.weight > 0 for leaf in tree):
        raise ValueError("the tree needs a shard of positive weight")
    text = F.coalesce(key.cast("string"), F.lit(""))
    at = F.lit("")
    for parent, level in (("", "region"), ("region", "rack"), ("rack", "shard")):
        children = F.element_at(_children(tree, parent, level), at)
        draws = F.transform(children, lambda c: F.struct((-F.log(unit_draw(text, c["name"])) / c["weight"]).alias("draw"), c["name"].alias("name")))
        at = F.array_min(draws)["name"]
    return df.withColumn(name, F.substring(at, 2, 10).cast("int"))


def assign_slots(placed: DataFrame, order: Sequence[str], rows: int, shard: str = "shard", name: str = "slot") -> DataFrame:
    """Gapless positions from 0 in every shard without one task per shard.

    A shard's rows are dealt over buckets by a hash of ``order``; a bucket is numbered by a window of about
    ``SLOTS_PER_BUCKET`` rows and starts where the buckets before it end. ``rows`` is the table's row count.
    """
    shards = placed.select(shard).distinct().count() if rows else 1
    buckets = max(1, math.ceil(rows / max(1, shards) / SLOTS_PER_BUCKET))
    b, at, own, part, start = (fresh(placed, c) for c in ("_bucket", "_at", "_shard", "_b", "_start"))
    dealt = placed.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(shard, b).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(shard).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias(own), F.col(b).alias(part), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(start))
    position = F.row_number().over(W.partitionBy(shard, b).orderBy(*order))
    numbered = dealt.withColumn(at, position).join(starts, (F.col(shard) == F.col(own)) & (F.col(b) == F.col(part)))
    return numbered.withColumn(name, (F.col(start) + F.col(at) - 1).cast("long")).drop(b, at, own, part, start)
