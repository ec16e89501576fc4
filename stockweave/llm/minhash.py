"""Near-duplicate documents by MinHash: minima, banding, signature check, exact check, connected components.

1. A document's set is its distinct word shingles. Documents with equal sets form a class; from here on only one
   document per class, the smallest id, takes part.
2. ``HASHES`` universal hashes give one minimum each; ``HASHES / ROWS`` bands of ``ROWS`` minima put classes into
   buckets. A pair at similarity 0.8 shares no bucket with probability (1 - 0.8 ** 4) ** 32 < 1e-7.
3. In a bucket every class is paired with the bucket's most central class only (a star, linear in the bucket).
   Signatures drop hopeless pairs (``SIGNATURE_SLACK`` below the threshold is over five standard errors), full
   sets decide the rest.
4. Links become components by alternating large-star and small-star. Members of buckets that now lie in one component
   are done. For the rest an exact prefix filter finds every pair across components that could still reach the
   threshold: shingles are ordered by their frequency among these documents (rare first), two similar sets share a
   shingle near the front of both, and that shingle's places bound their intersection. Documents of a component
   count as one until a bound lets a pair of components through, so groups of copies are never expanded into pairs.

Null and empty texts have no set: they are linked with nothing. Rows with a null or repeated ``doc_id`` count like
others; a component is named by its smallest id (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.frames import fresh, release, tidy
from stockweave.session import cut_lineage

HASHES, ROWS = 128, 4
SIGNATURE_SLACK = 0.2
MEMBERS_PER_SALT = 256
SKETCH_BITS = 18
_RNG = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_WORD_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def _stir(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    return x


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    sums = np.full(n, width, np.uint64)
    for k in range(width):
        sums = _stir(sums * np.uint64(31) + codes[k : k + n] * np.uint64(_WORD_MIX[k % 8]))
    return np.unique(sums)


def body_of(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def node_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of every hash ``(a * x + b) >> 32``; blocks keep memory bounded for very long texts."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 512):
        block = shingles[at : at + 512, None] * _MULTIPLY
        block += _ADD
        np.minimum(least, block.min(axis=0) >> np.uint64(32), out=least)
    return least.astype("<u4")


def sketch(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, body, n, node, sig, brief`` per row, the last three null for an empty set.

    ``node`` is a 128-bit hash of the set, ``sig`` holds the minima, ``brief`` their lowest bytes.
    """

    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingle_set(t, size)
            sig = signature(s) if len(s) else None
            rows.append((len(s), node_of(s), sig.tobytes(), sig.astype(np.uint8).tobytes()) if len(s) else (0, None, None, None))
        return pd.DataFrame(rows, columns=["n", "node", "sig", "brief"])

    made = F.pandas_udf(tidy(of), "n long, node binary, sig binary, brief binary")(F.col(text))
    return docs.select(F.col(key).alias("doc_id"), made.alias("s"), body_of(F.col(text)).alias("body")).select("doc_id", "body", "s.*")


def buckets(classes: DataFrame) -> DataFrame:
    """``bucket, id`` of every band of every class."""
    width = 4 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 1 + b * width, width)) for b in range(HASHES // ROWS)])
    return classes.select("id", F.explode(bands).alias("bucket"))


def signatures_agree(a: Column, b: Column, least: float) -> Column:
    def check(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        left = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
        right = np.frombuffer(b"".join(y), np.uint8).reshape(len(y), -1)
        return pd.Series((left == right).mean(axis=1) >= least)  # unequal minima agree in a byte by chance 1 in 256

    return F.pandas_udf(tidy(check), "boolean")(a, b)


def confirmed(pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold. ``sets``: ``id, n, brief, text`` of all their ends.

    Signatures first; then the text of ``a`` and the texts of its partners are streamed past each other, dealt over
    salts of about ``MEMBERS_PER_SALT`` partners, so a class with very many partners is spread over tasks.
    """
    near = pairs.join(sets.select(F.col("id").alias("a"), F.col("brief").alias("_sa"), F.col("n").alias("_na")), "a")
    near = near.join(sets.select(F.col("id").alias("b"), F.col("brief").alias("_sb"), F.col("n").alias("_nb")), "b")
    # A union is at least the larger set and an intersection at most the smaller one.
    near = near.where(100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb"))
    near = cut_lineage(near.where(signatures_agree(F.col("_sa"), F.col("_sb"), percent / 100 - SIGNATURE_SLACK)).select("a", "b"))
    # Only leaders of very many partners have salts: a small table, so that no join gathers their partners.
    hot = near.groupBy("a").count().where(F.col("count") > MEMBERS_PER_SALT)
    hot = cut_lineage(hot.select("a", F.ceil(F.col("count") / MEMBERS_PER_SALT).cast("int").alias("salts")))
    salted = F.coalesce(F.pmod(F.xxhash64("b"), "salts").cast("int"), F.lit(0))
    members = near.join(hot, "a", "left").select("a", salted.alias("salt"), F.lit(1).alias("role"), F.col("b").alias("id"))
    every = near.select("a").distinct().join(hot, "a", "left")
    leaders = every.select("a", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("id"))
    dealt = leaders.unionByName(members).join(sets.select("id", "text"), "id").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, leader = None, None
        for frame in frames:
            found = []
            for a, salt, role, other, text in zip(frame["a"], frame["salt"], frame["role"], frame["id"], frame["text"]):
                own = shingle_set(text, size)
                if role == 0:
                    at, leader = (bytes(a), salt), own
                elif at == (bytes(a), salt):
                    both = len(np.intersect1d(leader, own, assume_unique=True))
                    if 100 * both >= percent * (len(leader) + len(own) - both):
                        found.append((a, other))
            yield pd.DataFrame(found, columns=["a", "b"])

    return dealt.select("a", "salt", "role", "id", "text").mapInPandas(tidy(compare), "a binary, b binary")


def frequencies(sets: DataFrame, size: int) -> np.ndarray:
    """How many documents hold a shingle, by ``SKETCH_BITS`` of its hash: a table of bounded size.

    It only orders shingles; any order gives the same result, a telling one prunes more.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            slots = [shingle_set(t, size) >> np.uint64(64 - SKETCH_BITS) for t in frame["text"]]
            slot, n = np.unique(np.concatenate(slots) if slots else np.empty(0, np.uint64), return_counts=True)
            yield pd.DataFrame({"slot": slot.astype(np.int32), "n": n.astype(np.int64)})

    table = sets.select("text").mapInPandas(tidy(count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(1 << SKETCH_BITS, np.int64)
    found[table["slot"].to_numpy()] = table["n"].to_numpy()
    return found


def fronts(sets: DataFrame, size: int, percent: int) -> DataFrame:
    """``id, n, token, left``: every shingle near the front of a set, with the number of shingles from it on.

    A set as long or longer shares one of the first ``n - percent * n / 100`` shingles with each similar set.
    """
    shared = sets.sparkSession.sparkContext.broadcast(frequencies(sets, size))

    def front(texts: pd.Series) -> pd.Series:
        table, out = shared.value, []
        for t in texts:
            own = shingle_set(t, size)
            ranked = own[np.lexsort((own, table[own >> np.uint64(64 - SKETCH_BITS)]))]
            keep = len(own) - -(-percent * len(own) // 100) + 1
            out.append([{"token": t, "left": len(own) - i} for i, t in enumerate(ranked[:keep].view(np.int64).tolist())])
        return pd.Series(out)

    made = F.explode(F.pandas_udf(tidy(front), "array<struct<token:long,left:int>>")("text")).alias("f")
    return sets.select("id", "n", "c", made).select("id", "n", "c", "f.token", "f.left")


def open_pairs(sets: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` across components ``c`` of ``sets`` that the prefix filter cannot rule out."""
    probe = cut_lineage(fronts(sets, size, percent))
    enough = lambda left_a, left_b, sizes: (100 + percent) * F.least(left_a, left_b) >= percent * sizes
    index = probe.where((100 + percent) * F.col("left") >= 2 * percent * F.col("n"))  # the shorter set's front is shorter still

    def parts(rows: DataFrame, mark: str) -> DataFrame:
        return rows.groupBy("token", F.col("c").alias(f"c{mark}")).agg(F.max("left").alias(f"left{mark}"), F.min("n").alias(f"n{mark}"))

    met = parts(index, "i").join(parts(probe, "p"), "token").where(F.col("ci") != F.col("cp"))
    met = met.where(enough(F.col("lefti"), F.col("leftp"), F.col("ni") + F.col("np"))).select("token", "ci", "cp")
    short = met.join(index.select("token", F.col("c").alias("ci"), F.col("id").alias("x"), F.col("n").alias("nx"), F.col("left").alias("lx")), ["token", "ci"])
    both = short.join(probe.select("token", F.col("c").alias("cp"), F.col("id").alias("y"), F.col("n").alias("ny"), F.col("left").alias("ly")), ["token", "cp"])
    fit = (F.col("nx") <= F.col("ny")) & (100 * F.col("nx") >= percent * F.col("ny")) & enough(F.col("lx"), F.col("ly"), F.col("nx") + F.col("ny"))
    return both.where(fit).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``id, component`` of every id in ``edges a, b``: alternating large-star and small-star until nothing moves.

    Each step sends every edge to one endpoint's smallest neighbour: minima are pre-aggregated and joined back, so no
    task holds the neighbours of a hot id.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # pairs: u > v. Large-star looks at both directions, small-star at smaller neighbours only.
        ways = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u"), F.least("u", "m").alias("m"))
        linked = ways.join(least, "u")
        if large:
            moved = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where(F.col("u") != F.col("v")).distinct()

    pairs = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    sign = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = pairs.agg(F.count(F.lit(1)).alias("n"), sign.alias("s")).first()
    for _ in range(most):
        if not before["n"]:
            break
        pairs = cut_lineage(star(star(pairs, True), False))
        release(pairs.sparkSession)
        after = pairs.agg(F.count(F.lit(1)).alias("n"), sign.alias("s")).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def links(classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` that connect whatever comparing every pair of every bucket would connect."""
    members = buckets(classes)
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    held = cut_lineage(members.join(sizes, "bucket"))
    # The leader of a bucket is its member that meets most others anywhere: of a family of copies, the least edited one.
    central = held.groupBy("id").agg(F.sum("size").alias("weight"))
    leads = held.join(central, "id").groupBy("bucket").agg(F.max(F.struct("weight", "id"))["id"].alias("a"))
    shared = cut_lineage(held.join(leads, "bucket").select("bucket", "id", "a"))
    release(shared.sparkSession)
    sets = cut_lineage(texts_of(classes.join(shared.select("id").distinct(), "id"), texts, size))
    star = cut_lineage(shared.where("id <> a").select("a", F.col("id").alias("b")).distinct())
    known = cut_lineage(confirmed(star, sets, size, percent))
    release(known.sparkSession)
    tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    placed = shared.join(components(known), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("bucket")
    pending = placed.join(mixed, "bucket", "left_semi").select("id", "c").distinct()
    open_sets = cut_lineage(sets.join(pending, "id"))
    left = cut_lineage(open_pairs(open_sets, size, percent).join(tested, ["a", "b"], "left_anti"))
    release(left.sparkSession)
    return cut_lineage(known.unionByName(confirmed(left, sets, size, percent)))


def texts_of(classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``id, n, brief, text``: one text per class, found through the class's ``doc_id``."""
    named = texts.select(F.col("doc_id").alias("_doc"), "text")
    joined = classes.select("id", "n", "brief", "doc_id").join(named, F.col("doc_id").eqNullSafe(F.col("_doc")))

    def right(ids: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([node_of(shingle_set(t, size)) == bytes(i) for i, t in zip(ids, found)], dtype=bool)

    # A doc_id may name several rows with other texts; equal texts of one class count once.
    own = joined.where(F.pandas_udf(tidy(right), "boolean")("id", "text"))
    return own.groupBy("id").agg(F.first("n").alias("n"), F.first("brief").alias("brief"), F.min("text").alias("text"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``; ``component_id`` is the smallest id reachable."""
    found = groups(docs, size, percent, key, text)
    root = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("root"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"))


def groups(docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """``doc_id, n, node, body, c, root`` per row: ``c`` names the component, ``root`` is its smallest id.

    ``body`` is a 128-bit hash of the text itself; ``node``, ``c`` and ``root`` are null for an empty set.
    """
    sketched = cut_lineage(sketch(docs, size, key, text))
    grouped = sketched.where("n > 0").groupBy(F.col("node").alias("id"))
    classes = cut_lineage(grouped.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("brief").alias("brief")))
    release(docs.sparkSession)
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    owner = cut_lineage(components(links(classes, texts, size, percent)))
    placed = classes.select("id", "doc_id").join(owner, "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("c"))
    roots = placed.groupBy("c").agg(F.min("doc_id").alias("root"))
    named = placed.join(roots, "c").select(F.col("id").alias("node"), "c", "root")
    return sketched.select("doc_id", "n", "node", "body").join(named, "node", "left").select("doc_id", "n", "node", "body", "c", "root")


def drop_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group; columns unchanged.

    The document of smallest id stays (a null id comes last), of several texts under that id the one whose set and then
    text hash least. Rows are dropped by id and text, so other texts under the same id, also a null one, stay; rows that
    repeat the staying document's id and text are that document and stay too.
    """
    found = groups(docs, size, percent, key, text).where("node is not null").withColumn("rank", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node", "body"))
    first = found.groupBy("c").agg(F.min("rank").alias("first"))
    name, body = fresh(docs, "_gone"), fresh(docs, "_body")
    gone = found.join(first, "c").where(~F.col("rank").eqNullSafe(F.col("first"))).select(F.col("doc_id").alias(name), F.col("body").alias(body)).distinct()
    return docs.join(gone, F.col(key).eqNullSafe(F.col(name)) & (body_of(F.col(text)) == F.col(body)), "left_anti")
