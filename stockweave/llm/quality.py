"""Quality filtering by weak supervision: rules vote good or bad or abstain, EM learns how far to trust each.

Every rule looks at one aspect of a text and votes + (good) or - (bad), or abstains: 0 when the value lies between its
limits, "." when the text is too small to tell. EM learns what a 0 says; a "." says nothing. All documents' vote patterns are
counted by Spark (at most 4 ** rules of them, whatever the corpus); expectation-maximisation over these counts
estimates the share of good documents and each rule's vote rates given a good or bad document. A document's posterior
probability of being good replaces a conjunction of rules. The model learns from the documents that pass two base tests
(length and self-repetition); a document that fails one of them is not kept.

Null and empty texts have zero measures, on which every rule abstains; they fail the length floor.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.frames import fresh, tidy

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_distinct_words", "n_upper")
WINDOW = 8
_MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)
_SPACE = " \t\n\x0b\x0c\r"
_SPACE_BYTES = [ord(c) for c in _SPACE]
_SYMBOL_BYTES = [ord(c) for c in "#*$%&|<>"]


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = codes[:n] * _MIX[0]
    for k in range(1, WINDOW):
        sums += codes[k : k + n] * _MIX[k]
    order = np.argsort(sums, kind="stable")
    ranked = sums[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    # Equal sums are only candidates; the words themselves decide.
    groups = defaultdict(list)
    for i in order[np.concatenate([same, [False]]) | np.concatenate([[False], same])].tolist():
        groups[tuple(words[i : i + WINDOW])].append(i)
    change = np.zeros(len(words) + 1, np.int32)
    for places in groups.values():
        if len(places) > 1:
            np.add.at(change, places, 1)
            np.add.at(change, np.array(places) + WINDOW, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one whole text; zeros for null."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    ended = sum(line.rstrip()[-1:] in (b".", b"!", b"?") for line in lines)
    return (
        len(words), len(text) - int(counts[_SPACE_BYTES].sum()), int(counts[_SYMBOL_BYTES].sum()), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), ended, len(set(words)), int(counts[65:91].sum()),
    )


def measures(text: str | Column) -> Column:
    """A struct of the measures of each text."""

    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES)).astype("int64")

    # Said not to be deterministic, so that no filter on a measure makes Spark measure a text again.
    return F.pandas_udf(tidy(of), ", ".join(f"{m} long" for m in MEASURES)).asNondeterministic()(text)


@dataclass(frozen=True)
class Rule:
    """Votes by comparing the share ``part / whole`` with two limits; abstains in between and when ``whole`` is small."""

    name: str
    part: str
    whole: str
    good: tuple[float, float]
    bad_below: float = -1.0
    bad_above: float = math.inf
    least: int = 1

    def vote(self, m: Column) -> Column:
        share = m[self.part] / F.greatest(m[self.whole], F.lit(1))
        voted = F.when((share < self.bad_below) | (share > self.bad_above), "-").when(share.between(*self.good), "+").otherwise("0")
        return F.when(m[self.whole] >= self.least, voted).otherwise(".")


RULES = (
    Rule("symbols", "n_symbols", "n_words", (0.0, 0.02), bad_above=0.1),
    Rule("repeats", "n_repeat_words", "n_words", (0.0, 0.05), bad_above=0.2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", (0.0, 0.1), bad_above=0.3, least=3),
    Rule("word_length", "word_chars", "n_words", (4.0, 6.3), bad_below=3.2, bad_above=7.5),
    Rule("line_ends", "n_ended_lines", "n_lines", (0.9, 1.0), bad_below=0.5),
    Rule("vocabulary", "n_distinct_words", "n_words", (0.55, 1.0), bad_below=0.35, least=20),
    Rule("capitals", "n_upper", "word_chars", (0.0, 0.08), bad_above=0.2),
)


def votes(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One character per rule."""
    return F.concat(*[r.vote(m) for r in rules])


@dataclass(frozen=True)
class LabelModel:
    """Prior log-odds and, per rule and vote, the log-likelihood ratio of good against bad."""

    prior: float
    weights: tuple[dict[str, float], ...]

    def posterior(self, pattern: Column) -> Column:
        odds = F.lit(self.prior)
        for i, w in enumerate(self.weights):
            odds = odds + F.element_at(F.create_map(*[F.lit(x) for vote in "+-0." for x in (vote, w.get(vote, 0.0))]), F.substring(pattern, i + 1, 1))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit_label_model(counts: dict[str, int], rounds: int = 200, smooth: float = 1.0) -> LabelModel:
    """EM from the number of bad votes. Documents whose every rule abstains do not inform the model; no votes: even odds."""
    known = {p: n for p, n in sorted(counts.items()) if p.strip(".")}
    width = max((len(p) for p in counts), default=0)
    if not known:
        return LabelModel(0.0, tuple({"+": 0.0, "-": 0.0, "0": 0.0} for _ in range(width)))
    patterns = list(known)
    n = np.array([known[p] for p in patterns], float)
    table = np.array([["+-0.".index(c) for c in p] for p in patterns])
    # Rules abstain when unsure, so one bad vote starts as likely bad and two as surely bad.
    good = np.array([(0.9, 0.2, 0.05)[min(2, p.count("-"))] for p in patterns])
    for _ in range(rounds):
        share = ((n * good).sum() + smooth) / (n.sum() + 2 * smooth)
        rates = np.empty((2, width, 3))
        for side, w in enumerate((n * (1 - good), n * good)):
            for r in range(width):
                c = np.bincount(table[:, r], weights=w, minlength=4)[:3] + smooth
                rates[side, r] = c / c.sum()
        ratio = np.zeros((width, 4))
        ratio[:, :3] = np.log(rates[1]) - np.log(rates[0])
        ratio[:, 0] = np.maximum(ratio[:, 0], 0.0)  # no rule is worse than chance
        ratio[:, 1] = np.minimum(ratio[:, 1], 0.0)
        ratio[:, 2] = np.clip(ratio[:, 2], ratio[:, 1] - 1.0, ratio[:, 0])
        prior = math.log(share) - math.log1p(-share)
        odds = prior + ratio[np.arange(width)[None, :], table].sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return LabelModel(float(prior), tuple({c: float(ratio[r, k]) for k, c in enumerate("+-0")} for r in range(width)))


def base_failed(m: Column) -> Column:
    """Too short, or too much of the text repeats itself."""
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def learn(measured: DataFrame, m: str) -> LabelModel:
    """The label model of all documents that pass the base tests; their patterns are bounded by the rules."""
    judged = measured.where(~base_failed(F.col(m))).groupBy(votes(F.col(m)).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return fit_label_model({r["p"]: r["n"] for r in judged.collect()})


def judge(measured: DataFrame, m: str, threshold: float = 0.5) -> DataFrame:
    """Add ``p_good``, ``base_failed`` and ``kept`` to rows with a column ``m`` of measures (evaluated twice).

    Columns that bear one of these names already are kept under a name with an underscore in front.
    """
    for c in ("p_good", "base_failed", "kept"):
        own = next((x for x in measured.columns if x.lower() == c), None)
        if own:
            measured = measured.withColumnRenamed(own, fresh(measured, c))
    p = fresh(measured, "_pattern")
    good = learn(measured, m).posterior(F.col(p))
    judged = measured.withColumns({p: votes(F.col(m)), "base_failed": base_failed(F.col(m))}).withColumn("p_good", good)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).drop(p)


def filter_documents(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that pass, with their columns unchanged. The texts are measured once to fit and once to filter."""
    m = fresh(docs, "_measures")
    p = fresh(docs, "_pattern")
    good = learn(docs.select(measures(text).alias(m)), m).posterior(F.col(p)) >= threshold
    sound = docs.withColumn(m, measures(text)).where(~base_failed(F.col(m))).withColumn(p, votes(F.col(m)))
    return sound.where(good).select(*[F.col(f"`{c}`") for c in docs.columns])
