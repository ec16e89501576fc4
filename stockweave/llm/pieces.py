"""SentencePiece encoding and decoding by suffix-array matching.

A batch's unseen words are joined into one text. Its suffixes are sorted by their first characters (as many as the longest
piece has); binary search gives every piece of the vocabulary its range of suffixes, hence all its occurrences. Sorted by
position, the occurrences are the edges of a graph over the text, which is relaxed from left to right: at each position
exactly one piece can end the encoding of what lies before, namely the one that stands next to its predecessor's piece
as the merge rules would leave them. That makes the result equal to the merge procedure of the model file, in one pass.

Pieces have the word mark at their start only, so text is cut in front of every mark that follows another character, and
words already seen come from a bounded cache. Characters without a piece become byte pieces. Null and empty texts have
no ids. Decoding joins pieces and bytes; it restores every text in which the mark U+2581 itself does not occur (there it
gives a space, as the format demands). Ids are packed as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stockweave.llm.frames import tidy

MARK = "▁"
NORMAL, BYTE = 1, 6  # piece types of the file format
UNKNOWN, START, NONE = -2, -1, -3
BATCH_CHARS = 120_000
CACHE_ENTRIES = 120_000
PAIR_SLOTS = 1 << 20
NEVER = np.int64(1 << 40)
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class PieceModel:
    """The pieces of a byte-pair model file and how each is merged from two others."""

    pieces: list[str]
    ranks: np.ndarray  # order of merging; -1 for what is never merged
    left: np.ndarray
    right: np.ndarray
    usable: np.ndarray
    byte_ids: list[int]
    raw: list[bytes]
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    searchable: list[int] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or not proto.normalizer_spec.add_dummy_prefix or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a byte-pair model with a word mark in front and unchanged white space is expected")
        pieces = [p.piece for p in proto.pieces]
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        order = {i: r for r, i in enumerate(sorted((i for i in normal.values() if len(pieces[i]) > 1), key=lambda i: (-proto.pieces[i].score, i)))}
        n = len(pieces)
        ranks, left, right = np.full(n, -1, np.int64), np.full(n, NONE, np.int64), np.full(n, NONE, np.int64)
        usable = np.zeros(n, bool)
        keys, values = [], []
        for text, i in normal.items():
            if len(text) == 1:
                usable[i] = True
                continue
            ranks[i] = order[i]
            for cut in range(1, len(text)):
                a, b = normal.get(text[:cut]), normal.get(text[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    values.append(order[i])
            built = merge(text, normal, order)
            if built is not None:
                left[i], right[i] = built
                usable[i] = True
        ranked = np.argsort(keys)
        byte_ids, raw = [0] * 256, [p.replace(MARK, " ").encode() for p in pieces]
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                value = int(p.piece[3:5], 16)
                byte_ids[value], raw[i] = i, bytes([value])
            elif p.type != NORMAL:
                raw[i] = b""
        return cls(pieces, ranks, left, right, usable, byte_ids, raw, np.array(keys, np.int64)[ranked], np.array(values, np.int64)[ranked],
                   [i for i in normal.values() if usable[i]])

    def merged_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that two neighbours would merge to; ``NEVER`` if there is none."""
        key = a * len(self.pieces) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Would the merges leave ``a`` and ``b`` side by side?

        The last merges are taken back one after the other; wherever the two pieces at the border could have merged before
        the merge just taken back (the left one first among equals), they would not have stayed apart.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, before = a.copy(), b.copy(), np.full(len(a), NEVER)
        while len(live):
            joins = self.merged_rank(a, b) < before
            good[live[joins]] = False
            ra, rb = self.ranks[a], self.ranks[b]
            go = ~joins & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo = ra > rb
            before = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return good


def merge(text: str, normal: dict[str, int], order: dict[int, int]) -> tuple[int, int] | None:
    """The last two parts from which the merges build ``text``; None when they do not build it."""
    parts = list(text)
    while len(parts) > 2:
        ranks = [order.get(normal.get(a + b, NONE), NEVER) for a, b in zip(parts, parts[1:])]
        best = min(ranks)
        if best == NEVER:
            return None
        k = ranks.index(best)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    if len(parts) == 2 and all(p in normal for p in parts):
        return normal[parts[0]], normal[parts[1]]
    return None


class PieceEncoder:
    """Encodes texts batch by batch; one per worker."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        names = [model.pieces[i] for i in model.searchable]
        self.longest = max(map(len, names))
        self.ids = np.array(model.searchable, np.int64)
        self.lengths = np.array(list(map(len, names)), np.int64)
        self.chars = np.zeros((len(names), self.longest), np.int64)
        for row, name in enumerate(names):
            self.chars[row, : len(name)] = [ord(c) for c in name]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pair_key = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_good = np.zeros(PAIR_SLOTS, bool)
        self.joined = {a + b for name in names for a, b in zip(name, name[1:])}
        single = {name: i for name, i in zip(names, model.searchable) if len(name) == 1}
        self.tails = {c: np.array([single[c]], "<u4").tobytes() for c in ",." if c in single}

    # -- index, search, relax ---------------------------------------------------------------------------------

    def suffix_order(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """Suffixes in the order of their first ``longest`` characters.

        As many characters as fit into one number are compared at once; doubling does the rest. Returned besides: the
        sorted numbers, the character table behind them, its bits per character and the characters per number.
        """

        def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.argsort(keys)
            placed = keys[order]
            rank = np.empty_like(keys)
            rank[order] = np.cumsum(np.diff(placed, prepend=placed[:1]) != 0)
            return order, rank, placed

        present = np.zeros(int(max(codes.max(), self.chars.max())) + 2, bool)
        present[codes + 1] = True
        table = np.where(present, np.cumsum(present), 0)  # 0: a character that does not occur
        bits = int(present.sum() + 1).bit_length()
        width = max(1, min(self.longest, 62 // bits))
        dense = np.concatenate([table[codes + 1], np.zeros(width, np.int64)])
        keys = np.zeros(len(codes), np.int64)
        for k in range(width):
            keys = (keys << bits) | dense[k : k + len(codes)]
        order, rank, placed = ranked(keys)
        reach = width
        while reach < self.longest:
            after = np.zeros_like(rank)
            after[:-reach] = rank[reach:] + 1
            order, rank, _ = ranked(rank * (len(rank) + 1) + after)
            reach *= 2
        return order, placed, table, bits, width

    def ranges(self, codes: np.ndarray, order: np.ndarray, placed: np.ndarray, table: np.ndarray, bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one place in ``order`` of the suffixes that begin with each piece, by binary search."""
        padded = np.concatenate([codes, np.full(self.longest, -1, np.int64)])
        inside = np.arange(self.longest)[None, :] < self.lengths[:, None]
        dense = np.where(inside, table[self.chars + 1], 0)
        known = ((dense > 0) | ~inside).all(axis=1)
        least, most = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        for k in range(width):
            least = (least << bits) | dense[:, k]
            most = (most << bits) | np.where(inside[:, k], dense[:, k], (1 << bits) - 1)
        low = np.searchsorted(placed, least, side="left")
        high = np.where(known, np.searchsorted(placed, most, side="right"), low)

        def search(rows: np.ndarray, depth: int, wanted: np.ndarray) -> np.ndarray:
            lo, hi = low[rows], high[rows]
            while (lo < hi).any():
                mid = (lo + hi) // 2
                less = (lo < hi) & (padded[order[np.minimum(mid, len(order) - 1)] + depth] < wanted)
                lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
            return lo

        for depth in range(width, self.longest):  # pieces longer than a number go on character by character
            rows = np.flatnonzero((self.lengths > depth) & (low < high))
            if not len(rows):
                break
            wanted = self.chars[rows, depth]
            first, last = search(rows, depth, wanted), search(rows, depth, wanted + 1)
            low[rows], high[rows] = first, last
        return low, high

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stable`` through a direct-mapped table of pairs already decided; START and UNKNOWN never merge."""
        good = a < 0
        rows = np.flatnonzero(~good)
        key = a[rows] * len(self.model.pieces) + b[rows]
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        known = self.pair_key[slot] == key
        good[rows[known]] = self.pair_good[slot[known]]
        if not known.all():
            fresh, at = np.unique(key[~known], return_inverse=True)
            verdict = self.model.stable(fresh // len(self.model.pieces), fresh % len(self.model.pieces))
            good[rows[~known]] = verdict[at]
            self.pair_key[slot[~known]], self.pair_good[slot[~known]] = key[~known], verdict[at]
        return good

    def relax(self, units: list[str]) -> list[bytes]:
        """The packed ids of every unit, from one suffix array over all of them."""
        text = "".join(units)
        sizes = np.array(list(map(len, units)), np.int64)
        own = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        unit = np.repeat(np.arange(len(units)), sizes)
        codes = np.full(len(own) + len(units), -1, np.int64)  # -1 ends every unit
        codes[np.arange(len(own)) + unit] = own
        begin = np.cumsum(sizes + 1) - sizes - 1
        order, *numbers = self.suffix_order(codes)
        low, high = self.ranges(codes, order, *numbers)
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(self.ids)), count)
        place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        start = order[low[which] + place]
        token, end = self.ids[which], start + self.lengths[which]
        bare = np.ones(len(codes), bool)
        bare[start[self.lengths[which] == 1]] = False
        bare &= codes >= 0
        lone = np.flatnonzero(bare)
        start, token, end = np.concatenate([start, lone]), np.concatenate([token, np.full(len(lone), UNKNOWN)]), np.concatenate([end, lone + 1])
        owner = np.repeat(np.arange(len(units)), sizes + 1)[start]
        depth = end - begin[owner]
        small = depth.astype(np.int16) if sizes.max() < 32_000 else depth
        ranked = np.argsort(small, kind="stable")  # edges by the position at which they end
        start, token, end, depth = start[ranked], token[ranked], end[ranked], depth[ranked]
        last, back = np.full(len(codes) + 1, NONE, np.int64), np.full(len(codes) + 1, -1, np.int64)
        last[begin] = START
        cuts = np.searchsorted(depth, np.arange(1, int(sizes.max()) + 2))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            s, t, e = start[lo:hi], token[lo:hi], end[lo:hi]
            u = last[s]
            ok = (u != NONE) & ((t == UNKNOWN) | self.neighbours(np.where(t == UNKNOWN, START, u), np.maximum(t, 0)))
            last[e[ok]], back[e[ok]] = t[ok], s[ok]
        return self.trace(units, begin, begin + sizes, last, back, bare)

    def trace(self, units: list[str], begin: np.ndarray, stop: np.ndarray, last: np.ndarray, back: np.ndarray, bare: np.ndarray) -> list[bytes]:
        at, live, ends = stop.copy(), np.arange(len(units)), np.zeros(len(last), bool)
        if (last[stop] == NONE).any():
            raise ValueError("the model cannot encode a unit")
        while len(live):
            ends[at[live]] = True
            at[live] = back[at[live]]
            live = live[at[live] > begin[live]]
        where = np.flatnonzero(ends)  # units lie one behind the other
        what = last[where]
        bounds = np.append(np.searchsorted(where, begin), len(where))
        packed = np.maximum(what, 0).astype("<u4")
        odd = set((np.searchsorted(bounds, np.flatnonzero(what == UNKNOWN), side="right") - 1).tolist())
        out = []
        for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if i in odd:
                ids = []
                for t, e in zip(what[lo:hi].tolist(), where[lo:hi].tolist()):
                    ids += [t] if t >= 0 else [self.model.byte_ids[x] for x in units[i][e - begin[i] - 1].encode()]
                out.append(np.array(ids, "<u4").tobytes())
            else:
                out.append(packed[lo:hi].tobytes())
        return out

    # -- texts ------------------------------------------------------------------------------------------------

    def learn(self, words: set[str]) -> None:
        """Put the ids of words into the young cache; long words are relaxed together and short ones together.

        A word is the text behind a mark; a key that begins with a mark is itself the unit. A final comma or full stop that
        no piece holds behind another character is an edge of its own, so only the stem is looked up.
        """
        need, tailed = set(), []
        for word in words:
            if word in self.old:
                self.young[word] = self.old[word]
            elif word[-1:] in self.tails and len(word) > 1 and word[-2:] not in self.joined and word[-2] != MARK:
                tailed.append(word)
                need.add(word[:-1])
            else:
                need.add(word)
        block, held = [], 0
        for word in [*sorted(need, key=len), None]:
            if word is not None and word in self.young:
                continue
            if word is not None and word in self.old:
                self.young[word] = self.old[word]
                continue
            if block and (word is None or held >= BATCH_CHARS):
                self.young.update(zip(block, self.relax([w if w[:1] == MARK else MARK + w for w in block])))
                block, held = [], 0
            if word is not None:
                block.append(word)
                held += len(word) + 2
        for word in tailed:
            self.young[word] = self.young[word[:-1]] + self.tails[word[-1]]

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        units = _UNIT.findall(MARK + text.replace(" ", MARK))
        return [u if u[1:2] == MARK else u[1:] for u in units]

    def encode_batch(self, texts: list[str | None]) -> list[bytes | None]:
        out: list[bytes | None] = []
        for at in range(0, len(texts), 500):
            group = list(map(self.words, texts[at : at + 500]))
            every = set().union(*group)
            if len(self.young) > CACHE_ENTRIES:
                self.old, self.young = self.young, {}
            self.learn(every.difference(self.young))
            out += [b"".join(map(self.young.__getitem__, words)) for words in group]
        return [None if t is None else ids for t, ids in zip(texts, out)]

    def decode(self, packed: bytes | None) -> str | None:
        if packed is None:
            return None
        text = b"".join(map(self.model.raw.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of this file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(PieceModel.load(path))
    return _ENCODERS[path]


def encode(text: Column, path: str) -> Column:
    """Packed ids of each whole text; null for null. A task's words are forgotten at its end."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        try:
            for texts in batches:
                yield pd.Series(own.encode_batch(texts.tolist()), dtype=object)
        finally:
            own.young, own.old = {}, {}

    return F.pandas_udf(tidy(run), "binary")(text)


def digest(text: Column, path: str) -> Column:
    """Struct ``n_tokens, ids_crc32, round_trip`` of each whole text, encoded and decoded again in one task.

    The ids stay in the task; null has no ids and comes back as null.
    """

    def of(own: PieceEncoder, texts: list[str | None]) -> Iterator[tuple[int, int, bool]]:
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            for t, ids in zip(part, own.encode_batch(part)):
                yield len(ids or b"") // 4, zlib.crc32(ids or b""), own.decode(ids) == t

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        try:
            for texts in batches:
                yield pd.DataFrame(list(of(own, texts.tolist())), columns=["n_tokens", "ids_crc32", "round_trip"])
        finally:
            own.young, own.old = {}, {}

    return F.pandas_udf(tidy(run), "n_tokens long, ids_crc32 long, round_trip boolean")(text)


def decode(ids: Column, path: str) -> Column:
    return F.pandas_udf(lambda packed: pd.Series([encoder(path).decode(p) for p in packed], dtype=object), "string")(ids)
