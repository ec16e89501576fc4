"""Reversible line deduplication: exact reference counts, fronted by sharded cuckoo filters.

The exact table holds one reference per document and line key; inserting documents adds references, deleting
documents removes theirs, so counts and the document that keeps a line are always those of the present corpus.
Keys held by at least ``min_docs`` documents are *frequent*; a cuckoo filter per shard of the key space holds their
fingerprints. Filters learn newly frequent keys and forget keys that are frequent no more, without a rebuild.

To mark lines, keys first meet the filter of their shard; only those that pass are joined with the exact counts, which
decide. A key is a 128-bit hash of the stripped line with A-Z lower-cased.

Every row is a document; null and empty texts have one empty line. Rows that share a ``doc_id`` (null included) keep
or lose a line together.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.frames import fresh, tidy
from stockweave.session import cut_lineage

MIN_CHARS = 20
MIN_DOCS = 3
KEYS_PER_FILTER = 50_000
ROWS_PER_TASK = 1_000_000
SLOTS = 4


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key lies in one of two buckets, each found from the other."""

    def __init__(self, buckets: int) -> None:
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def for_keys(cls, count: int) -> "CuckooFilter":
        return cls(1 << max(2, math.ceil(math.log2(max(1, count) / (0.7 * SLOTS)))))

    @classmethod
    def loads(cls, raw: bytes) -> "CuckooFilter":
        self = cls.__new__(cls)
        self.table = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        return self

    def dumps(self) -> bytes:
        return self.table.tobytes()

    def places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys given as two 64-bit halves."""
        mask = np.uint64(len(self.table) - 1)
        prints = (lo.view(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint64)
        first = hi.view(np.uint64) & mask
        return prints.astype(np.uint16), first.astype(np.int64), ((first ^ (prints * np.uint64(0x5BD1E995))) & mask).astype(np.int64)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        prints, a, b = self.places(hi, lo)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def insert(self, hi: np.ndarray, lo: np.ndarray, seed: int = 7) -> bool:
        """Add keys; False when the filter is too full and must be built anew with more buckets."""
        rng, mask = random.Random(seed), len(self.table) - 1
        for p, a, b in zip(*(x.tolist() for x in self.places(hi, lo))):
            at = a if (self.table[a] == 0).any() else b
            for _ in range(500):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = p
                    break
                slot = rng.randrange(SLOTS)
                p, self.table[at, slot] = int(self.table[at, slot]), p
                at = (at ^ (p * 0x5BD1E995)) & mask
            else:
                return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Remove keys that were inserted."""
        for p, a, b in zip(*(x.tolist() for x in self.places(hi, lo))):
            for at in (a, b):
                found = np.flatnonzero(self.table[at] == p)
                if len(found):
                    self.table[at, found[0]] = 0
                    break


def split_keys(text: str) -> list[bytes | None]:
    """Per line its 16-byte key, or None where the line is too short."""
    keys = []
    for line in text.encode().lower().split(b"\n"):  # bytes.lower and bytes.strip know ASCII only, as wanted
        line = line.strip()
        long_enough = len(line) >= MIN_CHARS and (len(line) >= 4 * MIN_CHARS or len(line.decode()) >= MIN_CHARS)
        keys.append(xxhash.xxh3_128_digest(line) if long_enough else None)
    return keys


def line_references(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``hi, lo, doc_id``: one row per document and distinct long line."""

    def keys(texts: pd.Series) -> pd.Series:
        found = []
        for t in texts:
            own = b"".join({k for k in split_keys(t or "") if k is not None})
            found.append([{"hi": h, "lo": l} for h, l in np.frombuffer(own, "<i8").reshape(-1, 2).tolist()])
        return pd.Series(found)

    rows = docs.select(F.col(key).alias("doc_id"), F.pandas_udf(tidy(keys), "array<struct<hi:long,lo:long>>")(F.col(text)).alias("k"))
    return rows.select("doc_id", F.explode("k").alias("k")).select("k.hi", "k.lo", "doc_id")


def frequent_keys(references: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``hi, lo, n_docs, keeper``: how many documents hold the keys that enough of them hold, and the largest one.

    Rows of one ``doc_id`` are one document, rows without one too. The references keep a row each, so what was inserted can be
    taken out again; a key is counted per document before it is counted, so no task gathers a frequent line's rows.
    """
    counts = references.groupBy("hi", "lo").agg(F.count_distinct(F.struct("doc_id")).alias("n_docs"), F.max("doc_id").alias("keeper"))
    return counts.where(F.col("n_docs") >= min_docs)


def shard_of(shards: int) -> Column:
    return F.pmod(F.shiftright("hi", 32), F.lit(shards)).cast("int")


def build_filters(frequent: DataFrame, shards: int) -> DataFrame:
    """``shard, filter``: one cuckoo filter per shard of the key space; hashing keeps shards even."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        hi, lo = frame["hi"].to_numpy(np.int64), frame["lo"].to_numpy(np.int64)
        made = CuckooFilter.for_keys(len(frame))
        while not made.insert(hi, lo):
            made = CuckooFilter(2 * len(made.table))
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "filter": [made.dumps()]})

    return frequent.select("hi", "lo", shard_of(shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, filter binary")


def update_filters(filters: DataFrame, added: DataFrame, removed: DataFrame, shards: int, frequent: DataFrame | None = None) -> DataFrame:
    """Insert newly frequent keys and delete keys no longer frequent, shard by shard.

    A shard whose filter is full is built anew, larger, from ``frequent``, the exact table after the change; without it that is an error.
    """
    exact_known = frequent is not None
    kinds = [(added, 1), (removed, -1)] + ([(frequent, 0)] if exact_known else [])
    changes = None
    for keys, sign in kinds:
        part = keys.select("hi", "lo", F.lit(sign).alias("sign"))
        changes = part if changes is None else changes.unionByName(part)

    def apply(key, old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        def of(sign: int) -> tuple[np.ndarray, np.ndarray]:
            rows = change[change["sign"] == sign]
            return rows["hi"].to_numpy(np.int64), rows["lo"].to_numpy(np.int64)

        gone, new, exact = of(-1), of(1), of(0)
        made = CuckooFilter.loads(old["filter"].iloc[0]) if len(old) else CuckooFilter.for_keys(2 * len(new[0]))
        made.delete(*gone)
        if not made.insert(*new):
            if not exact_known:
                raise ValueError(f"the filter of shard {key[0]} is full: give the exact table, or build the filters anew with more shards")
            made = CuckooFilter(2 * len(made.table))
            while not made.insert(*exact):
                made = CuckooFilter(2 * len(made.table))
        return pd.DataFrame({"shard": [key[0]], "filter": [made.dumps()]})

    keyed = changes.withColumn("shard", shard_of(shards))
    return filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(apply, "shard int, filter binary")


def probe(references: DataFrame, filters: DataFrame, shards: int, salts: int) -> DataFrame:
    """References whose key may be frequent, by the filter of the key's shard.

    A shard's rows are dealt over ``salts`` tasks, to each of which goes a copy of the filter; rows are streamed past it.
    """
    salt = F.pmod(F.xxhash64("doc_id", "lo"), F.lit(salts)).cast("int")
    doc_type = references.schema["doc_id"].dataType
    rows = references.select(shard_of(shards).alias("shard"), salt.alias("salt"), F.lit(None).cast("binary").alias("filter"), "hi", "lo", "doc_id")
    copies = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "filter")
    copies = copies.select("*", F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), F.lit(None).cast(doc_type).alias("doc_id"))

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, current = None, None
        for frame in frames:
            is_filter = frame["filter"].notna().to_numpy()
            edges = [0, *(np.flatnonzero(is_filter)).tolist(), len(frame)]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                part = frame.iloc[start:stop]
                if is_filter[start]:
                    current, held = (part["shard"].iloc[0], part["salt"].iloc[0]), CuckooFilter.loads(part["filter"].iloc[0])
                    part = part.iloc[1:]
                if held is None or not len(part):
                    continue
                hi, lo = part["hi"].to_numpy(np.int64), part["lo"].to_numpy(np.int64)
                mine = ((part["shard"] == current[0]) & (part["salt"] == current[1])).to_numpy()
                yield part.loc[mine & held.contains(hi, lo), ["hi", "lo", "doc_id"]]

    dealt = copies.unionByName(rows).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
    schema = f"hi long, lo long, doc_id {doc_type.simpleString()}"
    return dealt.mapInPandas(tidy(match), schema)


def dropped_lines(references: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, dropped``: per document the keys of the lines it loses (``array<struct<hi,lo>>``)."""
    references = cut_lineage(references)
    frequent = cut_lineage(frequent_keys(references, min_docs))
    shards = max(1, math.ceil(frequent.count() / KEYS_PER_FILTER))
    salts = max(1, math.ceil(references.count() / shards / ROWS_PER_TASK))
    passed = probe(references, build_filters(frequent, shards), shards, salts)
    losing = passed.join(frequent, ["hi", "lo"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return losing.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("dropped"))


def insert_documents(references: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The references after documents were added."""
    return references.unionByName(line_references(docs, key, text))


def delete_documents(references: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The references after documents were removed; whatever was inserted for them is undone."""
    gone = ids.select(F.col(key).alias("_gone")).distinct()
    return references.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def _rewrite(texts: pd.Series, his: pd.Series, los: pd.Series) -> pd.DataFrame:
    rows = []
    for text, hi, lo in zip(texts, his, los):
        text = text or ""
        if hi is None or len(hi) == 0:
            rows.append((text.count("\n") + 1, 0, None))
            continue
        both = np.stack([np.asarray(hi, "<i8"), np.asarray(lo, "<i8")], axis=1)
        gone = {row.tobytes() for row in both}
        lines = text.split("\n")
        kept = [line for line, k in zip(lines, split_keys(text)) if k not in gone]
        rows.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, and struct column ``line_dedup`` of ``n_lines, n_dropped``.

    A line held by ``min_docs`` documents or more stays in the largest ``doc_id`` that holds it. Only documents that
    lose a line are rewritten; other texts, null included, stay as they are.
    """
    dropped = dropped_lines(line_references(docs, key, text), min_docs)
    d, r = fresh(docs, "_dropped"), fresh(docs, "_rewritten")
    other = fresh(docs, "_doc")
    dropped = dropped.select(F.col("doc_id").alias(other), F.col("dropped").alias(d))
    joined = docs.join(dropped, F.col(key).eqNullSafe(F.col(other)), "left")
    rewrite = F.pandas_udf(tidy(_rewrite), "n_lines long, n_dropped long, kept string")
    made = joined.withColumn(r, rewrite(F.col(text), F.col(f"{d}.hi"), F.col(f"{d}.lo")))
    kept = F.when(F.col(f"{r}.n_dropped") > 0, F.col(f"{r}.kept")).otherwise(F.col(text))
    columns = [kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return made.select(*columns, F.struct(F.col(f"{r}.n_lines").alias("n_lines"), F.col(f"{r}.n_dropped").alias("n_dropped")).alias(fresh(docs, "line_dedup")))
