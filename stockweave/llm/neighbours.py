"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

Equal vectors form a class that keeps its ``k + 1`` smallest ids, which is all that any query's ``k`` nearest can need
(ties go to smaller ids, and one id is the query's own), so a vector that many rows repeat is compared once and no class is hot.

The tree is fitted in the driver on a sample of at most about ``SAMPLE`` classes chosen by hash: each node splits its share by spherical k-means
into ``BRANCHES`` until a leaf's share of all rows is about ``LEAF_ROWS`` or too few sampled vectors are left. Every class is then
assigned to a leaf in parallel. A query walks the tree with a priority queue of unopened bins, the nearest centre
first, and visits leaves until it has seen the calibrated number of them and enough rows to fill its answer.

The number of leaves is calibrated, not set: for ``PROBES`` vectors chosen by hash the exact neighbours are found in one scan of all
classes, and the visits widen until they hold ``RECALL`` of those neighbours, up to all leaves, where the search is exact. On
vectors without clusters that is most of the leaves. Visits join the leaves' rows in blocks bounded on both sides.

Vectors that are null, zero, hold null or non-finite components or are not of the usual length take no part. Rows equal in id
and vector count once; rows sharing the query's id are its own. Null ids come last among ties and ask nothing. An empty table, or a
query without other vectors, gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stockweave.llm.vectors import as_doubles, matrix, usual_length
from stockweave.session import cut_lineage

SAMPLE = 40_000
BRANCHES = 12
LEAF_ROWS = 1024
LEAST_SAMPLED = 24
MAX_LEAVES = 4096
PROBES = 512
RECALL = 0.98
ROUNDS = 12
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 4096


def unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest  # squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def spherical_kmeans(vectors: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres and each unit vector's centre; centres that lose all their vectors are left out."""
    centres = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(ROUNDS):
        nearest = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        norms = np.sqrt((sums * sums).sum(axis=1))
        centres = sums[norms > 1e-12] / norms[norms > 1e-12, None]
    nearest = (vectors @ centres.T).argmax(axis=1)
    used, nearest = np.unique(nearest, return_inverse=True)
    return centres[used], nearest


@dataclass
class Tree:
    """Inner nodes by number, 0 the root: their children's centres, and the children (leaf ``x`` as ``-1 - x``)."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    n_leaves: int = 1

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        if not self.centres:
            yield 0
            return
        bins, pushed = [(0.0, 0, 0)], 1
        while bins:
            _, _, node = heapq.heappop(bins)
            if node < 0:
                yield -1 - node
                continue
            for far, child in zip((-(self.centres[node] @ query)).tolist(), self.children[node]):
                heapq.heappush(bins, (far, pushed, child))
                pushed += 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf at the end of each unit vector's descent to nearest centres."""
        leaves = np.zeros(len(vectors), dtype=np.int64)
        stack = [(0, np.arange(len(vectors)))] if self.centres else []
        while stack:
            node, rows = stack.pop()
            nearest = (vectors[rows] @ self.centres[node].T).argmax(axis=1)
            for at, child in enumerate(self.children[node]):
                part = rows[nearest == at]
                if child < 0:
                    leaves[part] = -1 - child
                elif len(part):
                    stack.append((child, part))
        return leaves


def fit_tree(sample: np.ndarray, total: int, leaf_rows: int = LEAF_ROWS, seed: int = 11) -> Tree:
    """A tree for ``total`` vectors, fitted on a sample of unit vectors; the largest node splits first."""
    tree, rng = Tree(), np.random.default_rng(seed)
    share, open_nodes, leaves, order = total / max(len(sample), 1), [], 0, 0

    def divisible(rows: np.ndarray) -> bool:
        return len(rows) * share > leaf_rows and len(rows) >= LEAST_SAMPLED

    if divisible(sample):
        heapq.heappush(open_nodes, (-len(sample), order, None, 0, np.arange(len(sample))))
    while open_nodes:
        _, _, parent, at, rows = heapq.heappop(open_nodes)
        full = leaves + len(open_nodes) + BRANCHES > MAX_LEAVES
        centres, nearest = spherical_kmeans(sample[rows], min(BRANCHES, len(rows) // 2), rng) if not full else (rows[:0], rows)
        if len(centres) < 2:
            if parent is not None:
                tree.children[parent][at] = -1 - leaves
                leaves += 1
            continue
        node = len(tree.centres)
        if parent is not None:
            tree.children[parent][at] = node
        tree.centres.append(centres)
        tree.children.append([0] * len(centres))
        for child in range(len(centres)):
            part = rows[nearest == child]
            if divisible(part):
                order += 1
                heapq.heappush(open_nodes, (-len(part), order, node, child, part))
            else:
                tree.children[node][child] = -1 - leaves
                leaves += 1
    tree.n_leaves = max(leaves, 1)
    return tree


def _bytes(vectors: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in vectors], pa.binary())


def _matrix(blobs: pa.Array | list, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.as_py() if isinstance(b, pa.Scalar) else b for b in blobs), dtype=np.float64).reshape(-1, dim)


def whole_vectors(df: DataFrame, id_column: str, column: str, dim: int) -> DataFrame:
    """``id, v``: the vectors that take part, as bytes of doubles (zeros without sign)."""
    kind = df.schema[id_column].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = matrix(batch.column(1), dim)
            some = vectors.any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[some])), _bytes(vectors[some] + 0.0)], ["id", "v"])

    return df.select(F.col(id_column).alias("id"), as_doubles(column).alias("vector")).mapInArrow(task, f"id {kind}, v binary")


def classes_of(whole: DataFrame, keep: int) -> DataFrame:
    """``key, v, ids``: every distinct vector with its ``keep`` smallest ids in order, null last."""
    ranked = whole.withColumn("place", F.dense_rank().over(Window.partitionBy("v").orderBy(F.asc_nulls_last("id")))).where(F.col("place") <= keep)
    ids = F.array_sort(F.collect_set(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"))))
    return ranked.groupBy("v").agg(F.transform(ids, lambda s: s["id"]).alias("ids")).select(F.md5("v").alias("key"), "v", "ids")


def _hash_below(share: float) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30))


def _assigned(classes: DataFrame, tree: Tree, dim: int) -> DataFrame:
    """``classes`` with their leaf."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = tree.assign(unit(_matrix(batch.column(1), dim))) if batch.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves)], ["key", "v", "ids", "leaf"])

    return classes.mapInArrow(task, f"key string, v binary, ids {classes.schema['ids'].dataType.simpleString()}, leaf long")


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the order of addition depends on the dimension only."""
    a, b = np.abs(queries).max(axis=1), np.abs(vectors).max(axis=1)
    queries, vectors = queries / a[:, None], vectors / b[:, None]
    return (queries * vectors).sum(axis=1) / np.sqrt((queries * queries).sum(axis=1) * (vectors * vectors).sum(axis=1))


def nearest(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and vector numbers of each query's ``k`` best vectors and more at equal score, with their cosines."""
    found = []
    units = unit(vectors)
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        scores = unit(part) @ units.T
        k_th = np.partition(scores, -k, axis=1)[:, -k] if k < scores.shape[1] else np.full(len(part), -2.0)
        q, v = np.nonzero(scores >= k_th[:, None] - 1e-12)
        found.append((q + at, v, cosines(part[q], vectors[v])))
    return tuple(np.concatenate(x) for x in zip(*found))


def _leaf_pairs(candidates: pa.Table, queries: pa.Table, dim: int, keep: int, schema: pa.Schema) -> pa.Table:
    if not candidates.num_rows or not queries.num_rows:
        return schema.empty_table()
    q, v, score = nearest(_matrix(queries["v"], dim), _matrix(candidates["v"], dim), keep)
    hits = pa.table({"key": queries["key"].take(pa.array(q)), "ids": candidates["ids"].take(pa.array(v)), "score": pa.array(score)})
    return hits.cast(schema)


def exact_leaves(classes: DataFrame, probes: list[tuple[str, bytes]], dim: int, k: int) -> list[tuple[int, int]]:
    """``(probe, leaf)`` of every probe's ``k`` exact neighbours, from one scan of all assigned classes."""
    wanted = _matrix([v for _, v in probes], dim)
    own = {key: at for at, (key, _) in enumerate(probes)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("v"), dim)
            q, v, score = nearest(wanted, vectors, k + 1)
            leaf = batch.column("leaf").to_numpy()[v]
            copies = np.array([len(x) for x in batch.column("ids")])[v]
            mine = np.array([own.get(x, -1) for x in batch.column("key").to_pylist()])[v] == q
            rows = np.repeat(np.arange(len(q)), np.minimum(np.where(mine, copies - 1, copies), k))
            new = (q[rows], leaf[rows], score[rows])
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            order = np.lexsort((-held[2], held[0]))
            starts = np.searchsorted(held[0][order], np.arange(len(wanted)))
            order = order[np.arange(len(order)) - starts[held[0][order]] < k]
            held = tuple(x[order] for x in held)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["probe", "leaf", "score"])

    hits = classes.mapInArrow(task, "probe long, leaf long, score double")
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "leaf"))
    return [(r["probe"], r["leaf"]) for r in hits.withColumn("place", place).where(F.col("place") <= k).collect()]


def calibrate(tree: Tree, probes: list[tuple[str, bytes]], exact: list[tuple[int, int]], dim: int, recall: float) -> int:
    """The fewest leaf visits that hold the share ``recall`` of the probes' exact neighbours."""
    units = unit(_matrix([v for _, v in probes], dim))
    places = [{leaf: at for at, leaf in enumerate(tree.walk(u), 1)} for u in units]
    needed = sorted(places[probe][leaf] for probe, leaf in exact)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def search(
    df: DataFrame, asks: Column, k: int = 5, id_column: str = "vec_id", column: str = "embedding",
    recall: float = RECALL, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``k`` nearest rows of every row for which ``asks`` holds."""
    kind = df.schema[id_column].dataType.simpleString()
    empty = df.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    dim, _ = usual_length(df, column)
    if not dim:
        return empty
    classes = cut_lineage(classes_of(whole_vectors(df, id_column, column, dim), k + 1))
    total = classes.count()
    if not total:
        return empty
    sample = classes.where(_hash_below(SAMPLE / total)).select("key", "v").orderBy("key").collect()
    tree = fit_tree(unit(_matrix([r["v"] for r in sample], dim)), total, leaf_rows)
    assigned = cut_lineage(_assigned(classes, tree, dim))
    probes = [(r["key"], r["v"]) for r in sample[: min(PROBES, len(sample))]]
    visits = calibrate(tree, probes, exact_leaves(assigned, probes, dim, k), dim, recall)
    leaves = assigned.groupBy("leaf").agg(F.count("*").alias("n")).collect()  # a row per leaf: at most MAX_LEAVES
    sizes = {r["leaf"]: r["n"] for r in leaves}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for at, query in enumerate(unit(_matrix(batch.column(1), dim)) if batch.num_rows else ()):
                rows_seen = 0
                for place, leaf in enumerate(tree.walk(query)):
                    if place >= visits and rows_seen > k:
                        break
                    rows_seen += sizes.get(leaf, 0)
                    rows.append(at)
                    found.append(leaf)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns), pa.array(found, pa.int64())], ["key", "v", "leaf"])

    asked = cut_lineage(whole_vectors(df.where(asks), id_column, column, dim).where("id IS NOT NULL").distinct().withColumn("key", F.md5("v")))
    questions = asked.groupBy("key").agg(F.first("v").alias("v"))
    routed = cut_lineage(questions.mapInArrow(route, "key string, v binary, leaf long"))
    asked_leaves = {r["leaf"]: r["n"] for r in routed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    blocks = [(leaf, -(-n // CANDIDATE_BLOCK), -(-asked_leaves.get(leaf, 0) // QUERY_BLOCK)) for leaf, n in sizes.items() if leaf in asked_leaves]
    if not blocks:
        return empty
    plan = F.broadcast(df.sparkSession.createDataFrame(blocks, "leaf long, c_blocks long, q_blocks long"))  # at most MAX_LEAVES rows
    number = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = assigned.join(plan, "leaf").select("leaf", (number % F.col("c_blocks")).alias("c"), upto("q_blocks").alias("q"), "v", "ids")
    right = routed.join(plan, "leaf").select("leaf", (number % F.col("q_blocks")).alias("q"), upto("c_blocks").alias("c"), "key", "v")
    shape = StructType.fromDDL(f"key string, ids {classes.schema['ids'].dataType.simpleString()}, score double")
    arrow = to_arrow_schema(shape)
    pairs = left.groupBy("leaf", "c", "q").cogroup(right.groupBy("leaf", "c", "q"))
    hits = pairs.applyInArrow(lambda a, b: _leaf_pairs(a, b, dim, k + 1, arrow), shape)
    hits = hits.select("key", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    best = hits.withColumn("place", place).where(F.col("place") <= k + 1)
    best = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    answers = asked.select(F.col("id").alias("query_id"), "key").join(best, "key")
    others = F.filter("best", lambda s: ~s["vec_id"].eqNullSafe(F.col("query_id")))
    ranked = answers.select("query_id", F.posexplode(F.slice(others, 1, k)))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "col.vec_id", "col.score")
