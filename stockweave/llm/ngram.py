"""Stupid-backoff language-model scores of every document against all other documents.

Words are the runs without ASCII white space, A-Z lower-cased. A word scores ``ln(c(context word) / c(context))`` with
the longest context that the corpus continues this way, and ``ln 0.4`` more for every order given up; without any
context it scores ``ln(max(c(word), 1/2) / N)``. Counts leave out the document being scored, N is the number of words
of the corpus. Word scores are rounded to millionths, so a document's sum does not depend on the order of addition.

The documents are dealt into blocks. Each block explodes its texts to n-grams and sends its distinct ones with their counts to the count
table, which is partitioned by order and hash; there every block's n-grams meet the totals of all blocks, and how often other blocks hold
each goes back, in the order in which the block sent them: the block makes its sorted n-grams again from its text, so no key travels
back. The block then sums the scores per document. A frequent n-gram is one entry per block, so no key is hot, and the
text is shuffled once for both passes. A block writes to those partitions only that it has n-grams of, so messages never outnumber
distinct n-grams per block and work is linear in the corpus.

N-grams are known by 62 bits of hash beside their order; two that collide would count as one, which has a chance of one in 10**10 in
a corpus of 30,000 n-grams and of one in a thousand at 100 million. Null and empty texts have no words and the score 0. Rows that repeat a ``doc_id`` are documents of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.frames import give_back, tidy

BLOCK_BYTES = 12 << 20
KEYS_PER_PART = 2_000_000
BACKOFF = 0.4
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = left * _STEP + (word ^ (word >> np.uint64(31)))
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    return x


def gram_keys(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words per text and, per order, the keys of the n-grams that end at each word and whether they lie in one text."""
    codes, lengths = [], []
    for t in texts:
        words = (t or "").encode().lower().split()
        lengths.append(len(words))
        codes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    one = np.concatenate(codes) if codes else np.empty(0, np.uint64)
    sizes = np.array(lengths, np.int64)
    place = np.arange(len(one)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys, whole = [one], [np.ones(len(one), bool)]
    for n in range(1, order):
        longer = np.zeros(len(one), np.uint64)
        longer[1:] = _mix(keys[-1][:-1], one[1:])
        keys.append(longer)
        whole.append(place >= n)
    return sizes, keys, whole


def tagged(key: np.ndarray, n: int) -> np.ndarray:
    """Keys of n-grams of ``n + 1`` words: the order in the top two bits, so that sorted keys are sorted by order first."""
    return (key >> np.uint64(2)) | np.uint64(n << 62)


def block_counts(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys of all orders, sorted, and their counts; one order at a time is in memory."""
    _, keys, whole = gram_keys(texts, order)
    distinct, counts = [], []
    for n in range(order):
        key, count = np.unique(tagged(keys[n][whole[n]], n), return_counts=True)
        distinct.append(key)
        counts.append(count)
    return np.concatenate(distinct), np.concatenate(counts)


def pack_sorted(values: np.ndarray) -> bytes:
    """Differences of sorted keys in byte planes: the upper planes are zeros that shuffle compression removes."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_planes(values: np.ndarray) -> bytes:
    """Byte planes of whole numbers, compressed: small numbers leave their upper planes empty."""
    return zstandard.ZstdCompressor(1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_planes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def score_block(texts: list[str | None], order: int, elsewhere: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words, words scored without context, score in millionths.

    ``elsewhere``: how often other blocks hold each of the block's sorted n-grams (``block_counts``).
    """
    sizes, keys, whole = gram_keys(texts, order)
    n = int(sizes.sum())
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    others, start = [], 0  # per order: occurrences in other documents
    for k in range(order):
        ok, key = whole[k], keys[k][whole[k]]
        if k + 1 == order:
            keys.clear()
        else:
            keys[k] = np.empty(0, np.uint64)
        distinct, at, count = np.unique(tagged(key, k), return_inverse=True, return_counts=True)
        stop = start + len(distinct)
        seen = (count + elsewhere[start:stop])[at]
        del distinct, at, count
        start = stop
        _, own_at, own = np.unique(_mix(key, doc[ok]), return_inverse=True, return_counts=True)
        seen -= own[own_at]
        del own_at, own, key
        full = np.zeros(n, np.int64)
        full[ok] = seen
        others.append(full)
    del whole, doc, elsewhere
    # The unigram comes first; every longer context that the other documents continue so replaces it.
    value = np.log(np.maximum(others[0], 0.5) / max(1, words)) + (order - 1) * math.log(BACKOFF)
    bare = np.ones(n, bool)
    for k in range(1, order):
        found = others[k] > 0
        context = np.ones(n)
        context[1:] = others[k - 1][:-1]
        better = np.log(np.maximum(others[k], 1) / np.maximum(context, 1)) + (order - 1 - k) * math.log(BACKOFF)
        value = np.where(found, better, value)
        bare &= ~found
    micro = np.rint(value * 1e6).astype(np.int64)
    ends = np.cumsum(sizes)
    running, alone = np.concatenate([[0], np.cumsum(micro)]), np.concatenate([[0], np.cumsum(bare)])
    return sizes, alone[ends] - alone[ends - sizes], running[ends] - running[ends - sizes]


def score_documents(docs: DataFrame, order: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_without_context, score_micro`` per row of ``docs``."""
    size = docs.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    ranges = max(1, math.ceil(size / 6 / KEYS_PER_PART))  # of the keys of each order
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    # Id and text decide, so rows without an id spread too.
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = rows.select("doc_id", _packed(F.col("text")).alias("packed"), block.alias("block")).repartition(blocks, "block")
    width = (1 << 62) // ranges + 1

    def count(group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = block_counts(_texts(group["packed"]), order)
        compress, block = zstandard.ZstdCompressor(1).compress, int(group["block"].iloc[0])
        part = (keys >> np.uint64(62)).astype(np.int64) * ranges + ((keys & np.uint64((1 << 62) - 1)) // np.uint64(width)).astype(np.int64)
        used, first = np.unique(part, return_index=True)
        del part
        out = [
            (int(p), block, compress(pack_sorted(keys[i:j])), pack_planes(counts[i:j]))
            for p, i, j in zip(used, first, [*first[1:], len(keys)])
        ]
        del keys, counts
        give_back()
        return pd.DataFrame(out, columns=["part", "block", "keys", "counts"])

    def total(group: pd.DataFrame) -> pd.DataFrame:
        expand = zstandard.ZstdDecompressor().decompress
        keys = [unpack_sorted(expand(k)) for k in group["keys"]]
        counts = [unpack_planes(c) for c in group["counts"]]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)[at]
        out, start = [], 0
        for part, block, c in zip(group["part"], group["block"], counts):
            out.append((block, part, pack_planes(sums[start : start + len(c)] - c)))
            start += len(c)
        del keys, counts, every, at, sums
        give_back()
        return pd.DataFrame(out, columns=["block", "part", "elsewhere"])

    counted = dealt.groupBy("block").applyInPandas(count, "part long, block int, keys binary, counts binary")
    totals = counted.groupBy("part").applyInPandas(total, "block int, part long, elsewhere binary")
    words = docs.select(F.col(text).alias("t")).mapInPandas(tidy(_word_counts), "n long").agg(F.sum("n").alias("n")).first()["n"] or 0

    def score(group: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        sent = [unpack_planes(e) for e in table.sort_values("part")["elsewhere"]]  # parts are ranges of the sorted keys
        elsewhere = np.concatenate(sent) if sent else np.empty(0, np.int64)
        del sent
        n, bare, micro = score_block(_texts(group["packed"]), order, elsewhere, words)
        del elsewhere
        give_back()
        return pd.DataFrame({"doc_id": group["doc_id"], "n_words": n, "n_without_context": bare, "score_micro": micro})

    kind = rows.schema["doc_id"].dataType.simpleString()
    both = dealt.groupBy("block").cogroup(totals.groupBy("block"))
    return both.applyInPandas(score, f"doc_id {kind}, n_words long, n_without_context long, score_micro long")


def _packed(text: Column) -> Column:
    """Every text compressed on its own: less than the shuffle's compression leaves of it."""

    def pack(texts: pd.Series) -> pd.Series:
        compress = zstandard.ZstdCompressor(1).compress
        return pd.Series([compress(t.encode()) if t else None for t in texts], dtype=object)

    return F.pandas_udf(tidy(pack), "binary")(text)


def _texts(packed: pd.Series) -> list[str]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(p).decode() if p is not None else "" for p in packed]


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"n": [sum(len((t or "").encode().split()) for t in frame["t"])]})
