"""Personal data: base patterns, high-recall generators, and boosted trees that choose among the generators' spans.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its test; they always stay.
Generators propose more, overlapping spans: other separators, missing plus signs, written-out signs, wrong check digits.
Each proposal has format and context features of a few values each and a label from evidence of its own, whether or not a base span is
there: its rewritten form passes the base test (``name (at) host (dot) org`` as an address, ``1[.]2[.]3[.]4`` as numbers up to 255,
digits with a right check digit), or, for phones, a valid number of digits after a plus sign, trunk prefix, bracket or hint word.
Spark counts examples per combination of features (a table bounded by the features' values); on
these counts, trees are boosted in the driver and turned back into one SQL expression. A fifth of the documents, chosen by
hash, calibrates one threshold per kind: the lowest score from which on proposals were right to ``PRECISION``, by the smoothed
share ``(right + 1) / (all + 2)``. Proposals above it that overlap neither a base span nor an added one of an earlier kind are added.

Everything on the rows is a column expression. Positions are code points, ends exclusive. Null texts are empty. Every text is searched
once; spans and features are written to the checkpoint folder and used from there.

Matching and selection take nearly linear time for any text. The patterns take runs whole (possessive) and start only where a run starts or the
previous match ended; positions are sums in two levels; whether spans overlap is read off a mask, a byte per code point.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with at most one separator between two: 13 to 19 digits, neither preceded nor followed by more
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?<![\w.%+-])[\w.%+-]{1,64}+ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:(?:\.|\[\.\])[0-9]{1,4}+){3}+(?![0-9])",
    "card": r"(?<![0-9])(?<![0-9][ ./-])[0-9](?:[ ./-]?[0-9]){11,19}(?![ ./-]?[0-9])",
    "phone": r"(?<![0-9+(])(?:\+|00|\()?+[0-9](?:[ ().-]{0,2}+[0-9]){6,15}+(?![0-9])",
}
FEATURES = ("kind", "digits", "marks", "letters", "opening", "before", "after", "hint", "width")
ROUNDS, SHRINK, PRECISION = 24, 0.3, 0.95
#: Words that announce a kind when they end the characters before a span.
HINTS = {
    "email": r"(?i)(?:mail|contact|write to)[^A-Za-z]*$",
    "ip": r"(?i)(?:\bip|host|server|addr(?:ess)?)[^A-Za-z]*$",
    "card": r"(?i)(?:card|visa|konto|cuenta|carte)[^A-Za-z]*$",
    "phone": r"(?i)(?:tel|phone|call|mobile?|fax)[^A-Za-z]*$",
}
GROUP = 128  # matches whose positions are added up at once


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of ``values``, each computed once: in a lambda, an outer expression would run again per element."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<s,e,m,b,a>>``: start, end, match, up to 16 characters before and the one after, of every match.

    The pieces between the matches come from splitting by the same pattern; positions are their running length, first within groups of
    ``GROUP`` matches, then over the groups.
    """
    nothing = F.from_json(F.lit("[]"), "array<struct<s:int,e:int,m:string,b:string,a:string>>")

    def placed(z: Column) -> Column:
        def group(first: Column) -> Column:
            part = F.slice(z["m"], first + 1, F.lit(GROUP))

            def step(acc: Column, m: Column) -> Column:
                i = first + F.size(acc["out"])
                gap, following = F.get(z["g"], i), F.concat(F.get(z["g"], i + 1), F.coalesce(F.get(z["m"], i + 1), F.lit("")))
                s = acc["at"] + F.length(gap)
                e = s + F.length(m)
                item = F.struct(s.alias("s"), e.alias("e"), m.alias("m"), F.right(gap, F.lit(16)).alias("b"), F.left(following, F.lit(1)).alias("a"))
                return F.struct(e.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

            return F.aggregate(part, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step)

        def shifted(y: Column) -> Column:
            ends = F.aggregate(
                y["groups"], F.array(F.lit(0)), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + g["at"]))
            )

            def moved(w: Column) -> Column:
                return F.flatten(F.transform(y["groups"], lambda g, i: F.transform(g["out"], lambda x: F.struct(
                    (x["s"] + F.get(w["ends"], i)).alias("s"), (x["e"] + F.get(w["ends"], i)).alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a")))))

            return let({"ends": ends}, moved)

        starts = F.sequence(F.lit(0), F.greatest(F.size(z["m"]) - 1, F.lit(0)), F.lit(GROUP))
        return F.when(F.size(z["m"]) == 0, nothing).otherwise(let({"groups": F.transform(starts, group)}, shifted))

    return let({"g": F.split(text, pattern, -1), "m": F.regexp_extract_all(text, F.lit(pattern), F.lit(0))}, placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _part_ok(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


TESTS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _part_ok),
    "card": lambda m: F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _needed(kind: str, text: Column, relaxed: bool) -> Column:
    """A cheap test that spares most texts the patterns."""
    if kind == "phone":  # any run of separators may stand between two digits
        return text.rlike("[0-9]" if relaxed else r"\+[0-9]")
    if kind == "ip" and relaxed:
        return text.rlike(r"[0-9](?:\.|\[\.\])[0-9]")
    if kind != "email":
        return text.rlike("[0-9].?[0-9]")
    return text.contains("@") | text.rlike(r"[(\[]at[)\]]") if relaxed else text.contains("@")


def _span(x: Column) -> Column:
    return F.struct(x["s"].alias("s"), x["e"].alias("e"))


def _empty(like: str) -> Column:
    return F.from_json(F.lit("[]"), like)


def base_spans(kind: str, text: Column) -> Column:
    """``array<struct<s,e>>`` of the matches that pass the kind's test."""
    valid = F.filter(matches(text, BASE[kind]), lambda x: TESTS[kind](x["m"]))
    spans = F.transform(valid, _span)
    return F.when(_needed(kind, text, False), spans).otherwise(_empty("array<struct<s:int,e:int>>"))


def _binned(value: Column, limits: Sequence[int]) -> Column:
    return reduce(lambda acc, x: acc + (value >= x).cast("int"), limits, F.lit(0))


AT, DOT = r" ?[(\[]at[)\]] ?", r" ?[(\[]dot[)\]] ?"


def evidence(kind: str, m: Column, before: Column) -> Column:
    """Whether the match is personal data by its rewritten form, digits and announcing words alone."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(m, AT, "@"), DOT, ".").rlike(rf"^[{LOCAL}]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,}}$")
    if kind == "ip":
        return TESTS["ip"](F.replace(m, F.lit("[.]"), F.lit(".")))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & TESTS["card"](m)
    return TESTS["phone"](m) & (m.rlike(r"^(?:\+|00[1-9]|0[1-9]|\(\+?[0-9])") | before.rlike(HINTS["phone"]))


def proposals(kind: str, text: Column) -> Column:
    """``array<struct<s,e,features,y>>`` of a generator's matches; ``y`` is the label."""

    def described(x: Column) -> Column:
        m, before, after = x["m"], F.right(F.rtrim(x["b"]), F.lit(1)), x["a"]
        others = reduce(lambda acc, k: acc | x["b"].rlike(HINTS[k]), [k for k in KINDS if k != kind], F.lit(False))
        values = {
            "kind": F.lit(KINDS.index(kind)),
            "digits": _binned(F.length(_digits(m)), (1, 7, 9, 12, 13, 16, 17)),
            "marks": _binned(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), (1, 2, 3, 4, 6)),
            "letters": _binned(F.length(F.regexp_replace(m, "[^A-Za-z]", "")), (1, 5, 20)),
            "opening": F.when(m.startswith("+"), 1).when(m.startswith("("), 2).when(m.startswith("0"), 3).otherwise(0),
            "before": F.when(before == "", 0).when(before.rlike("[A-Za-z]"), 1).when(before.rlike("[:=]"), 2).when(before.rlike("[0-9.]"), 3).otherwise(4),
            "after": F.when(after == "", 0).when(after.rlike(r"\s"), 1).when(after.rlike("[A-Za-z0-9]"), 2).when(after.rlike("[.,;]"), 3).otherwise(4),
            "hint": F.when(x["b"].rlike(HINTS[kind]), 2).when(others, 1).otherwise(0),
            "width": _binned(F.length(m), (8, 12, 15, 17, 20, 30)),
            "y": evidence(kind, m, x["b"]).cast("int"),
        }
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), *[F.coalesce(v, F.lit(0)).cast("int").alias(f) for f, v in values.items()])

    kind_of = "array<struct<s:int,e:int," + ",".join(f"{f}:int" for f in (*FEATURES, "y")) + ">>"
    return F.when(_needed(kind, text, True), F.transform(matches(text, GENERATORS[kind]), described)).otherwise(_empty(kind_of))


def mask(spans: Column) -> Column:
    """A byte per code point up to the last span's end: ``x`` inside one of the ordered spans, ``.`` between them."""

    def drawn(z: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(z["spans"], lambda x: x["e"]))
        strip = lambda w: F.transform(z["spans"], lambda x, i: F.concat(F.repeat(F.lit("."), x["s"] - F.get(w["ends"], i)), F.repeat(F.lit("x"), x["e"] - x["s"])))
        return F.array_join(let({"ends": ends}, strip), "")

    return F.when(F.size(spans) > 0, let({"spans": spans}, drawn)).otherwise("").cast("binary")


def _touches(c: Column, masked: Column) -> Column:
    return F.contains(F.substring(masked, c["s"] + 1, c["e"] - c["s"]), F.lit(b"x"))


@dataclass(frozen=True)
class Trees:
    """Depth-two trees: ``(feature, limit, (feature, limit, low, high), (feature, limit, low, high))`` on log-odds."""

    start: float
    trees: tuple
    thresholds: tuple[float, ...]

    def score(self, c: Column) -> Column:
        def leaf(node: tuple) -> Column:
            return F.when(c[FEATURES[node[0]]] <= node[1], node[2]).otherwise(node[3])

        return reduce(lambda acc, t: acc + F.when(c[FEATURES[t[0]]] <= t[1], leaf(t[2])).otherwise(leaf(t[3])), self.trees, F.lit(self.start))


def boost(x: np.ndarray, positive: np.ndarray, total: np.ndarray, calibrate: np.ndarray) -> Trees:
    """Logistic boosting on counted feature combinations; rows with ``calibrate`` set only choose thresholds."""
    fit = ~calibrate
    p, n = positive * fit, total * fit
    start = math.log((p.sum() + 1) / (n.sum() - p.sum() + 1))
    odds, trees = np.full(len(x), start), []

    def best(rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple:
        """The split of largest gain, and both sides' Newton steps."""
        step = lambda r: float(SHRINK * gradient[r].sum() / (weight[r].sum() + 1.0))
        choice = (0.0, 0, 1 << 20)
        for f in range(x.shape[1]):
            for limit in np.unique(x[rows, f])[:-1].tolist():
                low, high = rows & (x[:, f] <= limit), rows & (x[:, f] > limit)
                gain = sum(gradient[r].sum() ** 2 / (weight[r].sum() + 1.0) for r in (low, high))
                if gain > choice[0] + 1e-9:
                    choice = (gain, f, limit)
        _, f, limit = choice
        return f, limit, step(rows & (x[:, f] <= limit)), step(rows & (x[:, f] > limit))

    everything = np.ones(len(x), bool)
    for _ in range(ROUNDS if n.sum() else 0):
        chance = 1 / (1 + np.exp(-odds))
        gradient, weight = p - n * chance, n * chance * (1 - chance)
        f, limit, *_ = best(everything, gradient, weight)
        low = x[:, f] <= limit
        sides = best(low, gradient, weight), best(~low, gradient, weight)
        trees.append((f, limit, *sides))
        for rows, (g, cut, below, above) in zip((low, ~low), sides):
            odds = odds + np.where(rows, np.where(x[:, g] <= cut, below, above), 0.0)
    thresholds = []
    for kind in range(len(KINDS)):
        rows = np.flatnonzero(calibrate & (x[:, 0] == kind))
        rows = rows[np.argsort(-odds[rows], kind="stable")]
        hits, seen = np.cumsum(positive[rows]), np.cumsum(total[rows])
        last = np.concatenate([np.diff(odds[rows]) != 0, [True]]) if len(rows) else np.zeros(0, bool)  # whole ties only
        good = np.flatnonzero(last & ((hits + 1) / (seen + 2) >= PRECISION)) if len(rows) else []
        thresholds.append(float(odds[rows[good[-1]]]) if len(good) else math.inf)
    return Trees(start, tuple(trees), tuple(thresholds))


def prepared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, one base array and one array of proposals per kind."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.select("doc_id", *[base_spans(k, F.col("t")).alias(k) for k in KINDS], *[proposals(k, F.col("t")).alias(f"{k}_p") for k in KINDS])


def learn(found: DataFrame) -> Trees:
    """Boost on the counts of all proposals; their number of rows is bounded by the features' values."""
    calibrate = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    c = found.select(calibrate.alias("calibrate"), F.explode(F.concat(*[f"{k}_p" for k in KINDS])).alias("c"))
    cells = c.groupBy("calibrate", *[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(F.count(F.lit(1)).alias("n"), F.sum("c.y").alias("p")).collect()
    if not cells:
        return Trees(0.0, (), (math.inf,) * len(KINDS))
    cells.sort(key=lambda r: tuple(r[f] for f in FEATURES) + (r["calibrate"],))
    x = np.array([[r[f] for f in FEATURES] for r in cells])
    return boost(x, np.array([float(r["p"]) for r in cells]), np.array([float(r["n"]) for r in cells]), np.array([r["calibrate"] for r in cells]))


def with_spans(found: DataFrame, model: Trees) -> DataFrame:
    """Add ``<kind>_added``: ``array<struct<s,e>>`` of the proposals to redact besides the base spans."""
    blocked = [mask(F.col(k)) for k in KINDS]
    for number, kind in enumerate(KINDS):
        threshold = model.thresholds[number]
        if math.isinf(threshold):
            found = found.withColumn(f"{kind}_added", _empty("array<struct<s:int,e:int>>"))
            continue

        def chosen(z: Column) -> Column:
            free = lambda c: reduce(lambda a, b: a & b, [~_touches(c, z[f"m{i}"]) for i in range(len(blocked))])
            return F.transform(F.filter(z["p"], lambda c: (model.score(c) >= threshold) & free(c)), _span)

        values = {"p": F.col(f"{kind}_p"), **{f"m{i}": m for i, m in enumerate(blocked)}}
        found = found.withColumn(f"{kind}_added", let(values, chosen))
        blocked = [*blocked, mask(F.col(f"{kind}_added"))]
    return found


def span_texts(kind: str, added: bool) -> Column:
    """``kind:start:end`` of a kind's base spans, or of these and the added ones, by start."""
    spans = F.array_sort(F.concat(F.col(kind), F.col(f"{kind}_added"))) if added else F.col(kind)
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, counts and digest of the base spans, all ``spans``, how many there are and how many were added."""
    found = cut_lineage(prepared(docs, key, text))
    marked = with_spans(found, learn(found))
    joined = lambda added: F.array_join(F.concat(*[span_texts(k, added) for k in KINDS]), ",")
    sizes = lambda suffix: reduce(lambda a, b: a + b, [F.size(f"{k}{suffix}") for k in KINDS]).cast("long")
    return marked.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined(False).cast("binary"), 256).alias("base_sha256"),
        joined(True).alias("spans"), sizes("_added").alias("n_added"), (sizes("") + sizes("_added")).alias("n_private"),
    )
