"""Benchmark decontamination by greedy string tiling.

Texts are compared as words: lower-cased runs of letters and digits, ASCII punctuation as separators. Windows of ``LEAST`` words that a
document shares with a benchmark item are seeds; for every item with a seed, running Karp-Rabin finds the matches, of which the
longest unmarked one is marked on both sides, again and again. An item whose words are covered to
``THRESHOLD`` by such tiles contaminates the document, also when its parts come in another order.

The benchmark is the query set. It is taken in blocks of about ``BLOCK_WORDS`` words; each block is indexed once, sent
to the tasks, met by every document in one pass without a shuffle, and released. Documents are compared one by one, so a passage
that many documents hold is no hot key.

Items of fewer than ``LEAST`` words, also of none, must be found whole, with every number and symbol: as their tokens in
one run. Numbers with points or commas inside are one token, every other symbol is one. Null and blank items are ignored.
Repeated items are reported each; empty and null documents are clean.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.frames import fresh, tidy
from stockweave.session import cut_lineage

LEAST = 5
THRESHOLD = 0.8
BLOCK_WORDS = 500_000
BROADCAST_ROWS = 50_000  # digests of contaminated texts sent to every task at most, 32 characters each
_SEPARATORS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+(?:(?<=[0-9])[.,](?=[0-9])[a-z0-9\x80-\xff]+)*|[^\s]")
FRONT = 4
_BASE, _PRIME = 1_000_003, (1 << 61) - 1
HITS = "array<struct<item:long,words:int,covered:int,tiles:int>>"


def word_list(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SEPARATORS).split()


def token_list(text: str | None) -> list[bytes]:
    """Words, numbers and single symbols in order; only white space is left out."""
    return _TOKEN.findall((text or "").lower().encode())


def rolling(words: list[int]) -> list[int]:
    """Karp-Rabin prefix values: the value of any window follows from two of them."""
    values, h = [0], 0
    for w in words:
        h = (h * _BASE + w) % _PRIME
        values.append(h)
    return values


def shared_length(doc: list[int], p: int, item: list[int], q: int, known: int) -> int:
    """How many words agree from ``p`` and ``q`` on, ``known`` of them already: doubled steps, then halves."""
    limit, step = min(len(doc) - p, len(item) - q), max(known, 8)
    while known < limit:
        n = min(step, limit - known)
        if doc[p + known : p + known + n] == item[q + known : q + known + n]:
            known, step = known + n, 2 * step
            continue
        while n > 1:
            half = n // 2
            if doc[p + known : p + known + half] == item[q + known : q + known + half]:
                known, n = known + half, n - half
            else:
                n = half
        break
    return known


def greedy_tiles(doc: list[int], item: list[int], starts: list[int], least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles ``(doc position, item position, length)``, always the longest left, ties by position.

    ``starts``: the positions of ``doc`` where a window of ``least`` words of the item begins; tiles begin there too.
    Karp-Rabin values find the windows. Only matches that cannot be extended to the left are taken, so a run of equal words
    gives one per position and not one per pair of positions; what a longer tile leaves of a match is looked at again.
    """
    if not starts or len(item) < least:
        return []
    hd, hi, power = rolling(doc), rolling(item), pow(_BASE, least, _PRIME)
    windows: dict[int, dict[int | None, list[int]]] = defaultdict(lambda: defaultdict(list))  # by value and the word before
    for q in range(len(item) - least + 1):
        windows[(hi[q + least] - hi[q] * power) % _PRIME][item[q - 1] if q else None].append(q)
    heap = []
    for p in starts:
        before = doc[p - 1] if p else None
        for word, places in windows.get((hd[p + least] - hd[p] * power) % _PRIME, {}).items():
            if word is None or word != before:
                for q in places:
                    if doc[p : p + least] == item[q : q + least]:
                        heap.append((-shared_length(doc, p, item, q, least), p, q))
    heapq.heapify(heap)
    free_doc, free_item, left, tiles = bytearray(b"\1") * len(doc), bytearray(b"\1") * len(item), len(item), []
    while heap and left >= least:
        size, p, q = heapq.heappop(heap)
        size = -size
        taken = _first(free_doc, p, p + size), _first(free_item, q, q + size)
        if min(taken) == size:
            free_doc[p : p + size] = free_item[q : q + size] = bytes(size)
            left -= size
            tiles.append((p, q, size))
            continue
        for start, n in _free_runs(free_doc, p, free_item, q, size):
            if n >= least:
                heapq.heappush(heap, (-n, p + start, q + start))
    return tiles


def _first(free: bytearray, start: int, stop: int) -> int:
    """The first marked place, from ``start`` on."""
    found = free.find(0, start, stop)
    return stop - start if found < 0 else found - start


def _free_runs(free_doc: bytearray, p: int, free_item: bytearray, q: int, size: int):
    """Start and length of the stretches of a match that are unmarked on both sides."""
    at = 0
    while at < size:
        n = min(_first(free_doc, p + at, p + size), _first(free_item, q + at, q + size))
        if n:
            yield at, n
        at += n
        while at < size and not (free_doc[p + at] and free_item[q + at]):
            here, there = free_doc.find(1, p + at, p + size), free_item.find(1, q + at, q + size)
            at = size if here < 0 or there < 0 else max(here - p, there - q, at)


class Index:
    """Words, seed windows and items of one benchmark block."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int, threshold: float) -> None:
        self.least, self.threshold = least, threshold
        self.words: dict[bytes, int] = {}
        self.items: list[tuple[int | None, list[int]]] = []
        self.seeds: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        self.fronts: dict[int, dict[tuple[bytes, ...], list[tuple[int, list[bytes]]]]] = defaultdict(lambda: defaultdict(list))
        for name, text in items:
            found = word_list(text)
            at = len(self.items)
            if len(found) < least:
                if tokens := token_list(text):
                    self.items.append((name, [0] * len(found)))
                    front = tuple(tokens[:FRONT])
                    self.fronts[len(front)][front].append((at, tokens))
                continue
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in found]
            self.items.append((name, ids))
            for q in range(len(ids) - least + 1):
                owners = self.seeds[least][tuple(ids[q : q + least])]
                if not owners or owners[-1] != at:
                    owners.append(at)
        self.seeds = {width: dict(windows) for width, windows in self.seeds.items()}
        self.fronts = {width: dict(starts) for width, starts in self.fronts.items()}

    def whole(self, text: str | None) -> set[int]:
        """The short items whose tokens the text holds in one run."""
        found: set[int] = set()
        tokens = token_list(text) if self.fronts else []
        for width, starts in self.fronts.items():
            for p in range(len(tokens) - width + 1):
                for at, item in starts.get(tuple(tokens[p : p + width]), ()):
                    if at not in found and tokens[p : p + len(item)] == item:
                        found.add(at)
        return found

    def hits(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """``(item, words, covered words, tiles)`` of the items that contaminate a whole text."""
        if not text or not self.items:
            return []
        words, short = word_list(text), self.whole(text)
        ids = np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        starts: dict[int, list[int]] = {at: [] for at in short}
        doc = None
        for width, windows in self.seeds.items():
            if len(ids) < width:
                continue
            places = np.flatnonzero(known[width:] - known[:-width] == width)  # every word is one of the benchmark's
            if len(places) and doc is None:
                doc = ids.tolist()
            for p in places.tolist():
                for at in windows.get(tuple(doc[p : p + width]), ()):
                    starts.setdefault(at, []).append(p)
        out = []
        for at in sorted(starts):
            name, item = self.items[at]
            if at in short:
                out.append((name, len(item), len(item), 1))
                continue
            tiles = greedy_tiles(doc, item, starts[at], self.least)
            covered = sum(n for _, _, n in tiles)
            if covered >= self.threshold * len(item):
                out.append((name, len(item), covered, len(tiles)))
        return out


def blocks(benchmark: DataFrame, key: str, text: str, least: int, threshold: float):
    """One index per block of items, each collected on its own; a block's size is bounded by ``BLOCK_WORDS``."""
    size = benchmark.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0
    count = max(1, math.ceil(size / 6 / BLOCK_WORDS))
    for b in range(count):
        part = benchmark.where(F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(count)) == b)
        yield Index([(r[0], r[1]) for r in part.select(F.col(key).cast("long"), text).collect()], least, threshold)


def hits_of(shared, text: Column) -> Column:
    """Items of a block, by its broadcast index, that contaminate each text."""

    @tidy
    def find(texts: pd.Series) -> pd.Series:
        here = shared.value
        return pd.Series([[dict(zip(("item", "words", "covered", "tiles"), h)) for h in here.hits(t)] for t in texts])

    return F.pandas_udf(find, HITS)(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, item_words, covered_words, n_tiles`` per document and item that contaminates it."""
    return _found(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t")), benchmark, item_key, item_text, least, threshold)


def _found(rows: DataFrame, benchmark: DataFrame, item_key: str, item_text: str, least: int, threshold: float) -> DataFrame:
    """Hits of the texts ``t`` with the rows' other columns, one block of the benchmark after the other.

    A block's hits are written before the next block is built, so the driver and the workers hold one index at a time.
    """
    out = None
    for index in blocks(benchmark, item_key, item_text, least, threshold):
        shared = rows.sparkSession.sparkContext.broadcast(index)
        hit = cut_lineage(rows.withColumn("h", F.explode(hits_of(shared, F.col("t")))).drop("t"))
        shared.destroy()
        out = hit if out is None else out.unionByName(hit)
    item = {"item_id": "item", "item_words": "words", "covered_words": "covered", "n_tiles": "tiles"}
    return out.select(*[c for c in out.columns if c != "h"], *[F.col(f"h.{v}").alias(k) for k, v in item.items()])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                      least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that no item contaminates, with their columns unchanged. Equal texts go together."""
    digest = F.md5(F.col(text).cast("binary"))
    gone = _found(docs.select(F.col(text).alias("t"), digest.alias("_text")), benchmark, item_key, item_text, least, threshold)
    name = fresh(docs, "_gone")
    gone = cut_lineage(gone.select(F.col("_text").alias(name)).distinct())
    if gone.count() <= BROADCAST_ROWS:  # a measured size: then the documents need no shuffle
        gone = F.broadcast(gone)
    return docs.join(gone, digest == F.col(name), "left_anti")
