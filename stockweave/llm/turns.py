"""Conversation structure repair: Wagner-Fischer alignment of the turns to every feasible grammar string.

A well-formed conversation has the role initials ``(s?(ua)+)?``: nothing, or alternating user and assistant turns after an
optional system turn. Edits per row: keep 0, change the role to user or assistant 1, delete 2 (the only choice for blank rows
and duplicates), and inserting an empty user or assistant turn 5; a truncated row that stays costs 5 more. The cheapest edits win,
of equal ones those whose initials ``K R D I`` in order are least in ASCII.

For one length the grammar string is fixed, so it is a plain edit distance: the table of costs to the end is filled inside
Ukkonen's band, the diagonals that can still lie on a path no dearer than the best length so far, and backtraced by
the least letter among cheapest edits. Lengths that could not reach the best cost are not tried; audits of equal cost are compared.

Rows are aligned in blocks of ``BLOCK``, from each of the four places in the grammar (nothing yet, after s, after u, after a) to
each other, to every feasible piece of the grammar string. Two audits of the same rows and cost are never a prefix of one
another (the longer one would have an insertion more), so keeping the best audit per place is exact. Conversations of up to ``LONG``
rows are streamed in order. Longer ones are dealt by a range sort into parts that many tasks align at once, from every
place to every place; the parts' audits then join up per conversation. Only the digest of the repaired text, which is
sequential, reads such a conversation in one task, row by row. Its memory is that of the audits, a letter a row.

Null roles and texts are one space, null turns come first, rows of equal turn stand in order of role and text. Role initials
are first characters as they stand (an empty role has none and fits nowhere). Repeated rows are rows of their own, hence duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stockweave.session import cut_lineage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
DELETED, INSERTED, RENAMED, CUT = 2, 5, 1, 5
#: Places in the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {"u": "user", "a": "assistant"}
BLOCK = 16
LONG = 2048
WHITE = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}

Row = tuple[str, bool, bool]  # role initial, must go, is truncated


def grammar_strings(start: int, longest: int) -> Iterator[tuple[str, int]]:
    """All pieces of the grammar string of at most ``longest`` letters from ``start``, with the place each ends at."""
    yield "", start
    heads = {START: ("s", "u"), SYSTEM: ("u",), USER: ("a",), ASSISTANT: ("u",)}[start]
    for head in heads:
        text = head
        while len(text) <= longest:
            yield text, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[text[-1]]
            text += "a" if text[-1] == "u" else "u"


def _shift(diagonal: int) -> int:
    """The least cost of moving by so many diagonals: insertions to the right, deletions to the left."""
    return INSERTED * diagonal if diagonal > 0 else -DELETED * diagonal


def align(rows: Sequence[Row], target: str, most: float) -> tuple[int, str] | None:
    """The cheapest edits that turn ``rows`` into ``target`` and their audit; ``None`` if they cost more than ``most``."""
    n, m = len(rows), len(target)
    if _shift(m - n) > most:
        return None
    band = [d for d in range(-n, m + 1) if _shift(d) + _shift(m - n - d) <= most]
    low, high, infinite = band[0], band[-1], 1 << 60
    cost = [[infinite] * (m + 2) for _ in range(n + 2)]
    for i in range(n, -1, -1):
        here, below = cost[i], cost[i + 1]
        if i < n:
            initial, gone, cut = rows[i]
            stay = CUT if cut else 0
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            if i == n and j == m:
                here[j] = 0
                continue
            best = infinite
            if i < n:
                best = below[j] + DELETED
                if not gone and j < m:
                    if initial == target[j]:
                        best = min(best, below[j + 1] + stay)
                    elif target[j] != "s":
                        best = min(best, below[j + 1] + stay + RENAMED)
            if j < m and target[j] != "s":
                best = min(best, here[j + 1] + INSERTED)
            here[j] = best
    total = cost[0][0]
    if total >= infinite or total > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        left = cost[i][j]
        initial, gone, cut = rows[i] if i < n else ("", True, False)
        stay = CUT if cut else 0
        if i < n and cost[i + 1][j] + DELETED == left:
            audit.append(DELETE)
            i += 1
        elif j < m and target[j] != "s" and cost[i][j + 1] + INSERTED == left:
            audit.append(INSERT)
            j += 1
        else:
            audit.append(KEEP if initial == target[j] else REROLE)
            i, j = i + 1, j + 1
    return total, "".join(audit)


@lru_cache(maxsize=8192)  # few patterns of faults recur
def best_edits(rows: tuple[Row, ...], start: int, ends: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """Per reachable place in ``ends`` the cheapest cost and its ASCII-least audit."""
    n, found = len(rows), {}
    bound = DELETED * n + 2 * INSERTED  # all rows deleted and two inserted reaches every place but a system turn, which is no dearer
    pieces = [(text, end) for text, end in grammar_strings(start, n + bound // INSERTED) if end in ends]
    for text, end in sorted(pieces, key=lambda p: _shift(len(p[0]) - n)):  # likely lengths first: narrower bands for the rest
        done = align(rows, text, found[end][0] if end in found else bound)
        if done and (end not in found or done < found[end]):
            found[end] = done
    return found


class Paths:
    """The cheapest edits of the rows so far, from one place in the grammar to every other."""

    def __init__(self, start: int = START):
        self.at: dict[int, tuple[int, str]] = {start: (0, "")}
        self.rows: list[Row] = []

    def add(self, row: Row) -> None:
        if len(self.rows) == BLOCK:
            self.flush()
        self.rows.append(row)

    def flush(self, ends: tuple[int, ...] = (START, SYSTEM, USER, ASSISTANT)) -> None:
        best: dict[int, tuple[int, str]] = {}
        for place, (cost, audit) in self.at.items():
            for end, (more, edits) in best_edits(tuple(self.rows), place, ends).items():
                if end not in best or (cost + more, audit + edits) < best[end]:
                    best[end] = (cost + more, audit + edits)
        self.at, self.rows = best, []

    def finish(self) -> tuple[int, str]:
        """Cost and audit of the cheapest edits to a whole grammar string."""
        self.flush((START, ASSISTANT))
        return min(self.at.values())


def repaired(rows: Iterator[tuple[str, str]], audit: str, place: int = START) -> Iterator[str]:
    """The lines ``role:text`` that the edits leave of rows ``(role, text)``."""
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(rows)
        if edit == DELETE:
            continue
        if edit != KEEP:
            role = "assistant" if place == USER else "user"
        place = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        yield f"{role}:{text}"


def digest(lines: Iterator[str]) -> str:
    sha, between = hashlib.sha256(), ""
    for line in lines:
        sha.update((between + line).encode())
        between = "\n"
    return sha.hexdigest()


def is_blank(text: str) -> bool:
    return not text.strip(WHITE)


def is_truncated(text: str) -> bool:
    return text.rstrip(WHITE)[-1:] not in (".", "!", "?")


class Counts:
    """Faults and turns of rows in order; ``joined`` adds those of the rows that follow."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.head: str | None = None
        self.tail: str | None = None
        self.first: int | None = None
        self.last: int | None = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> Row:
        blank = is_blank(text)
        truncated = not blank and not seen and is_truncated(text)
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + (seen and not blank), self.truncated + truncated
        self._meet(role[:1], turn)
        self.tail = role[:1]
        if turn is not None:
            self.distinct, self.last = self.distinct + (turn != self.last), turn
        return role[:1], blank or seen, truncated

    def _meet(self, head: str, turn: int | None) -> None:
        if self.tail is not None:
            self.illegal += self.tail + head not in LEGAL
        self.head = head if self.head is None else self.head
        self.first = turn if self.first is None else self.first

    def joined(self, more: dict) -> None:
        self._meet(more["head"], more["first"])
        self.distinct += more["distinct"] - (more["first"] is not None and more["first"] == self.last)
        self.tail, self.last = more["tail"], self.last if more["last"] is None else more["last"]
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + more[name])

    def result(self) -> dict:
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
EDGES = "blank long, duplicate long, truncated long, illegal long, distinct long, head string, tail string, first long, last long"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from batch.slice(at, 1024).to_pylist()


def _groups(records: Iterator[dict], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of records that agree in ``keys``, nulls included."""
    return groupby(records, key=lambda r: tuple(r[k] for k in keys))


def _mapped(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``rows`` over the records of every partition, in order."""
    shape = StructType.fromDDL(schema)
    arrow = to_arrow_schema(shape)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows(_records(batches)):
            held.append(row)
            if len(held) == 1024:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return df.mapInArrow(task, shape)


def _short(records: Iterator[dict]) -> Iterator[dict]:
    for (key,), group in _groups(records, "c"):
        counts, paths, texts, seen = Counts(), Paths(), [], set()
        for r in group:
            if r["here"]:
                pair = (r["r"], r["x"])
                paths.add(counts.add(r["t"], *pair, pair in seen))
                seen.add(pair)
                texts.append(pair)
        cost, audit = paths.finish()
        yield {"c": key, **counts.result(), "cost": cost, "audit": audit, "repaired_sha256": digest(repaired(iter(texts), audit))}


def _parts(records: Iterator[dict]) -> Iterator[dict]:
    """The edits of a part of a long conversation, between all places, and what the faults at its edges need."""
    for (key, part), group in _groups(records, "c", "p"):
        counts, paths = Counts(), [Paths(start) for start in range(4)]
        for r in group:
            for k in range(r["copies"]):
                row = counts.add(r["t"], r["r"], r["x"], k > 0 or not r["new"])
                for path in paths:
                    path.add(row)
        edges = {k: getattr(counts, k) for k in EDGES.replace(" long", "").replace(" string", "").split(", ")}
        for start, path in enumerate(paths):
            path.flush()
            for end, (cost, audit) in path.at.items():
                yield {"c": key, "p": part, "begin": start, "until": end, "cost": cost, "audit": audit, **edges}


def _joined(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """One long conversation: the chosen edits of every part, and with them the counts of the whole."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["p"], r["begin"], r["until"]))
    counts, at, chosen = Counts(), {START: (0, "", ())}, {}
    for (part,), group in _groups(iter(rows), "p"):
        options: dict[int, tuple] = {}
        for k, r in enumerate(group):
            if k == 0:
                counts.joined(r)
            if r["begin"] in at:
                cost, audit, way = at[r["begin"]]
                option = (cost + r["cost"], audit + r["audit"], (way, part, r["begin"], r["audit"]))
                if r["until"] not in options or option[:2] < options[r["until"]][:2]:
                    options[r["until"]] = option
        at = options
    ends: dict[tuple[int, str], tuple] = {}
    for place, (cost, audit, way) in at.items():
        for more, edits in best_edits((), place, (START, ASSISTANT)).values():
            ends.setdefault((cost + more, audit + edits), (way, place, edits))
    (cost, audit), (way, place, edits) = min(ends.items(), key=lambda e: e[0])
    out = [{"p": None, "begin": place, "edits": edits}]
    while way:
        way, part, begin, done = way
        out.append({"p": part, "begin": begin, "edits": done})
    whole = {"c": rows[0]["c"], **counts.result(), "cost": cost}
    return pa.Table.from_pylist([{**whole, **o} for o in out], schema)


def _hashed(records: Iterator[dict]) -> Iterator[dict]:
    """One long conversation: edits of a part come before its rows, insertions after all parts last."""
    for (key,), group in _groups(records, "c"):
        totals, audit = {}, []

        def lines(group=group, totals=totals, audit=audit) -> Iterator[str]:
            for _, part in _groups(group, "p"):
                first = next(part)
                totals.update({k: first[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")})
                audit.append(first["edits"])
                texts = ((r["r"], r["x"]) for r in part for _ in range(r["copies"]))
                yield from repaired(texts, first["edits"], first["begin"])

        sha = digest(lines())
        yield {"c": key, **totals, "audit": "".join(audit), "repaired_sha256": sha}


def _long(rows: DataFrame) -> DataFrame:
    order = ["c", F.asc_nulls_first("t"), "r", "x"]
    rows = rows.groupBy("c", "t", "r", "x").agg(F.count("*").alias("copies"))
    firsts = rows.groupBy(F.col("c").alias("fc"), F.col("r").alias("fr"), F.col("x").alias("fx")).agg(F.min(F.struct(F.col("t").isNotNull(), F.col("t").alias("t"))).alias("f"))
    marked = rows.join(firsts, F.col("c").eqNullSafe(F.col("fc")) & (F.col("r") == F.col("fr")) & (F.col("x") == F.col("fx")))
    marked = marked.select("c", "t", "r", "x", "copies", F.col("t").eqNullSafe(F.col("f.t")).alias("new"))
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.withColumn("p", F.spark_partition_id().cast("long")))
    kind = rows.schema["c"].dataType.simpleString()
    parts = _mapped(dealt, _parts, f"c {kind}, p long, begin int, until int, cost long, audit string, {EDGES}")
    schema = f"c {kind}, {COUNTS}, cost long, p long, begin int, edits string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    chosen = parts.groupBy("c").applyInArrow(lambda t: _joined(t, arrow), StructType.fromDDL(schema))
    both = chosen.withColumn("edit", F.lit(True)).unionByName(dealt.drop("new").withColumn("edit", F.lit(False)), allowMissingColumns=True)
    both = both.repartition("c").sortWithinPartitions("c", F.asc_nulls_last("p"), F.desc("edit"), F.asc_nulls_first("t"), "r", "x")
    return _mapped(both, _hashed, f"c {kind}, {COUNTS}, cost long, audit string, repaired_sha256 string")


def repair(df: DataFrame, here: Column | None = None, long: int = LONG) -> DataFrame:
    """Per ``conv_id``: gaps, faults, illegal steps, and cost, audit and digest of the cheapest repair.

    Rows for which ``here`` is not true count for nothing, but their conversation is returned; one without other rows has
    zeros, an empty audit and the digest of the empty string.
    """
    present = F.lit(True) if here is None else F.coalesce(here, F.lit(False))
    kind = df.schema["conv_id"].dataType.simpleString()
    rows = df.select(
        F.col("conv_id").alias("c"), F.col("turn").cast("long").alias("t"),
        F.when(present, F.coalesce("role", F.lit(" "))).alias("r"), F.when(present, F.coalesce("text", F.lit(" "))).alias("x"), present.alias("here"),
    )
    big = rows.where("here").groupBy(F.col("c").alias("big")).count().where(F.col("count") > long).select("big")
    big, out = cut_lineage(big), []
    same = F.col("c").eqNullSafe(F.col("big"))
    some = not big.isEmpty()
    small = (rows.join(big, same, "left_anti") if some else rows).repartition("c")
    small = small.sortWithinPartitions("c", F.asc_nulls_first("t"), "r", "x")
    result = _mapped(small, _short, f"c {kind}, {COUNTS}, cost long, audit string, repaired_sha256 string")
    if some:
        result = result.unionByName(_long(rows.where("here").join(big, same, "left_semi")))
    return result.withColumnRenamed("c", "conv_id")


def damage(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, here``: rows spoilt by the CRC-32 of ``conv_id:turn`` (nulls as one space) modulo 20.

    0 drops the row (``here`` is false), 1 empties its text, 2 takes its sentence marks away, 3 repeats it, 4 makes its role user.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    body = F.when(fault == 1, "").when(fault == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    role = F.when(fault == 4, "user").otherwise(text("role"))
    times = F.explode(F.when(fault == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(fault != 0)))
    return df.select("conv_id", "turn", role.alias("role"), body.alias("text"), times.alias("here"))
