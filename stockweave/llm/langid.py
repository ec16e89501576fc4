"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Subwords are the byte n-grams of 2 to 4 bytes of the lower-cased text, hashed into ``BUCKETS`` rows of an embedding table.
A text is the mean of its subwords' embeddings. The model is fitted on a sample bounded by ``SAMPLE_PER_LANG`` texts of at
most ``SAMPLE_CHARS`` characters per language, the ones of smallest hash; prediction reads whole texts. Because mean and
softmax input are linear, table and output layer fold into one table of logits per subword for prediction.

A fifth of the sample is held back: a temperature makes scores match its accuracy, and ``accept`` is the smallest
score from which on ``PRECISION`` of it is right. A text below is predicted but marked as not accepted.

Texts that are null or have no letter are ``und`` with score 0 and not accepted; so is every text when there is nothing
to learn from. With one language every text with a letter is that language with score 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockweave.llm.frames import tidy

BUCKETS, WIDTH = 1 << 16, 16
SAMPLE_PER_LANG, SAMPLE_CHARS = 800, 8_000
EPOCHS, RATE = 6, 4.0
PRECISION = 0.99
CHUNK = 1 << 18
NGRAMS = (2, 3, 4)
UNKNOWN = "und"


def subwords(text: str) -> list[np.ndarray]:
    """Bucket numbers of the n-grams of a whole text, in chunks of bounded size."""
    raw = (" " + text.lower() + " ").encode()
    found = []
    longest = max(NGRAMS)
    for at in range(0, max(1, len(raw) - 1), CHUNK):
        b = np.frombuffer(raw[at : at + CHUNK + longest - 1], np.uint8).astype(np.uint32)
        own = min(CHUNK, len(raw) - at)  # n-grams that begin in this chunk
        for n in NGRAMS:
            m = min(own, len(b) - n + 1)
            if m <= 0:
                continue
            code = np.full(m, n, np.uint32)
            for k in range(n):
                code = code * np.uint32(0x01000193) ^ b[k : k + m]
            code *= np.uint32(0x9E3779B1)
            found.append(code >> np.uint32(32 - 16))
    return found


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # BUCKETS x languages, temperature applied
    accept: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        total, count = np.zeros(len(self.langs)), 0
        for idx in subwords(text):
            total += self.logits[idx].sum(axis=0, dtype=np.float64)
            count += len(idx)
        z = total / max(1, count)
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    rows, counts = np.unique(np.concatenate(subwords(text)), return_counts=True)
    return rows, (counts / counts.sum()).astype(np.float32)


def train(sample: list[tuple[str, str]], seed: int = 11) -> Model:
    """Fit on ``(text, language)`` pairs; their order does not matter."""
    rng = np.random.default_rng(seed)
    sample = sorted((t, lang) for t, lang in sample if has_letter(t))
    langs = sorted({lang for _, lang in sample})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0)
    order = rng.permutation(len(sample))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    code = {lang: k for k, lang in enumerate(langs)}
    table = (rng.random((BUCKETS, WIDTH), dtype=np.float32) - 0.5) / WIDTH
    out = np.zeros((WIDTH, len(langs)), np.float32)
    data = []
    for i in fit.tolist():
        text, lang = sample[i]
        at = int(rng.integers(0, max(1, len(text) - 40)))
        for piece in (text, text[at : at + int(rng.integers(20, 200))]):  # short texts are to be recognised too
            if has_letter(piece):
                data.append((*_counts(piece), code[lang]))
    steps, done = EPOCHS * len(data), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)).tolist():
            rows, share, k = data[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            hidden = share @ table[rows]
            z = hidden @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[k] -= 1
            back = out @ p
            out -= (rate / 4) * np.outer(hidden, p)
            table[rows] -= rate * share[:, None] * back
    model = Model(langs, table @ out, 1.0)
    scale, accept = calibrate(model, [sample[i] for i in held.tolist()])
    return Model(langs, (model.logits * scale).astype(np.float32), accept)


def calibrate(model: Model, held: list[tuple[str, str]]) -> tuple[float, float]:
    """The factor on the logits with the least log loss on held-back texts, and the score to accept from."""
    if not held or len(model.langs) < 2:
        return 1.0, 0.0
    code = {lang: k for k, lang in enumerate(model.langs)}
    z = np.array([np.mean(model.logits[np.concatenate(subwords(t))], axis=0) for t, _ in held])
    k = np.array([code[lang] for _, lang in held])

    def chances(factor: float) -> np.ndarray:
        e = np.exp(factor * (z - z.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)

    scale = min(np.geomspace(0.1, 10, 41), key=lambda f: -np.log(np.maximum(chances(f)[np.arange(len(k)), k], 1e-12)).mean())
    p = chances(scale)
    best, right = p.max(axis=1), p.argmax(axis=1) == k
    order = np.argsort(-best, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    return float(scale), float(best[order[good[-1]]]) if len(good) else 1.0


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """At most ``SAMPLE_PER_LANG`` labelled texts per language outside the held-out fifth, chosen by hash.

    Of a text of more than ``SAMPLE_CHARS`` characters a window of that length is taken whose place the hash chooses, so a language that
    has long texts only is learned too.
    """
    labelled = docs.where(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    h = F.xxhash64(F.col(key), F.col(text))
    start = F.pmod(h, F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1).cast("int")
    window = F.when(F.length(text) > SAMPLE_CHARS, F.substr(F.col(text), start + 1, F.lit(SAMPLE_CHARS))).otherwise(F.col(text))
    rows = labelled.select(window.alias("t"), F.col(lang).alias("l"), h.alias("h"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not counts:
        return []
    # Of a common language only small hashes come near the sample, so no task gathers more than a few samples' rows.
    limit = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 2.0 * SAMPLE_PER_LANG / n))])
    likely = rows.where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.element_at(limit, F.col("l")))
    place = F.row_number().over(W.partitionBy("l").orderBy("h", "t"))
    found = likely.withColumn("r", place).where(F.col("r") <= SAMPLE_PER_LANG).select("t", "l").collect()
    return [(r["t"], r["l"]) for r in found]


def identify(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Struct ``lang, score, accepted`` for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: pd.Series) -> pd.DataFrame:
        here = shared.value
        rows = [here.predict(t) for t in texts]
        return pd.DataFrame([(a, s, a != UNKNOWN and s >= here.accept) for a, s in rows], columns=["lang", "score", "accepted"])

    return F.pandas_udf(tidy(of), "lang string, score double, accepted boolean")(F.col(text))
