"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Every component ``c`` of a vector becomes the integer ``x = floor(64 c) + 1000000``. Rows whose vector is null, holds null or
non-finite components, or does not have the table's usual length (the most frequent one, the longer of equals) are left out; so
are components beyond ``2**61 / 64``, which have no exact ``x``. Every row left belongs to the fit list; repeated rows count each.

Three scans, each a partial sum per task and one sum per matrix entry: the per-dimension sums ``S`` (exact), the scatter of
``x - round(S / n)`` (integers, so products are exact in doubles below 2**53 and the result does not depend on the order of
addition), corrected by the fractions of the means, and the covariance of the whitened vectors. What reaches the driver is bounded
by the square of the dimension. The driver factors that matrix: Cholesky with the largest remaining diagonal as pivot stops at
the numerical rank; plane rotations then make the factor's columns orthogonal, after which squared column norms are
eigenvalues of the scatter and the normalised columns its eigenvectors. Components of variance zero are not returned, so a table
of equal vectors, of one vector or of none gives no rows. ``deviation`` is exact, and null where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.vectors import as_doubles, matrix, usual_length

SCALE, SHIFT = 64.0, 1_000_000
LARGEST = 2.0**61
ROWS_PER_BATCH = 4096


@dataclass(frozen=True)
class Whitening:
    """``components`` has one column per component, ``variances`` their eigenvalues, both in falling order."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def middle(self) -> np.ndarray:
        """The means rounded to integers."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        """``S - n * middle``: at most ``n / 2`` each."""
        return np.array([s - self.n * int(m) for s, m in zip(self.sums, self.middle)], dtype=np.int64)

    def project(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.middle).astype(np.float64) - self.rest / self.n
        return centred @ self.components / np.sqrt(self.variances)


def integers(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have an exact ``x``, and their ``x``."""
    scaled = np.floor(SCALE * vectors)
    fits = (np.abs(scaled) < LARGEST).all(axis=1)
    return np.flatnonzero(fits), scaled[fits].astype(np.int64) + SHIFT


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """``L`` with ``L @ L.T == a`` up to rounding, one column per pivot; as many columns as the numerical rank."""
    rest, d = a.astype(np.float64).copy(), len(a)
    floor, columns = d * np.finfo(float).eps * max(rest.diagonal().max(initial=0.0), 0.0), []
    for _ in range(d):
        p = int(np.argmax(rest.diagonal()))
        if rest[p, p] <= floor:
            break
        column = rest[:, p] / np.sqrt(rest[p, p])
        columns.append(column)
        rest -= np.outer(column, column)
        rest[p, :] = rest[:, p] = 0.0
    return np.array(columns).T if columns else np.zeros((d, 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` with its columns rotated in pairs until all are orthogonal; disjoint pairs turn at once."""
    u = factor.copy()
    r = u.shape[1]
    if r < 2:
        return u
    ring, tolerance = list(range(r + r % 2)), np.finfo(float).eps * len(u)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            pairs = np.array([(a, b) for a, b in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]) if max(a, b) < r])
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = u[:, pairs[:, 0]], u[:, pairs[:, 1]]
            a, b, c = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            size = np.sqrt(a * b)
            turn = np.abs(c) > tolerance * size
            worst = max(worst, float(np.max(np.abs(c) / np.where(size > 0, size, 1.0))))
            half = (b - a) / np.where(turn, 2 * c, 1.0)
            t = np.where(half >= 0, 1.0, -1.0) / (np.abs(half) + np.hypot(1.0, half))
            cos = np.where(turn, 1 / np.hypot(1.0, t), 1.0)
            sin = np.where(turn, t * cos, 0.0)
            u[:, pairs[:, 0]], u[:, pairs[:, 1]] = cos * p - sin * q, sin * p + cos * q
        if worst <= tolerance:
            break
    return u


def _summed(df: DataFrame, column: str, dim: int, partial) -> dict[tuple[int, int], float]:
    """Entries of the sums over all rows of ``partial(x)``, a dictionary of matrices; one partial sum per task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            x = integers(matrix(batch.column(0), dim)[1])[1]
            for at in range(0, len(x), ROWS_PER_BATCH):
                part = partial(x[at : at + ROWS_PER_BATCH])
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    parts = df.select(as_doubles(column).alias("v")).mapInArrow(task, "i long, j long, v double")
    return {(r["i"], r["j"]): r["v"] for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def _sums(df: DataFrame, column: str, dim: int) -> tuple[int, tuple[int, ...]]:
    """Rows, and the exact sum of ``x`` per dimension."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, [0] * dim
        for batch in batches:
            x = integers(matrix(batch.column(0), dim)[1])[1]
            n += len(x)
            high, low = (x >> 31).sum(axis=0), (x & (2**31 - 1)).sum(axis=0)
            totals = [t + (int(h) << 31) + int(lo) for t, h, lo in zip(totals, high, low)]
        if n:
            sums = pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int64()), pa.array([n] * dim, pa.int64()), sums], ["i", "n", "s"])

    parts = df.select(as_doubles(column).alias("v")).mapInArrow(task, "i long, n long, s decimal(38,0)")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (found[0]["n"], tuple(int(r["s"]) for r in found)) if found else (0, ())


def fit(df: DataFrame, column: str = "embedding", limit: int = 32) -> Whitening | None:
    """The first ``limit`` components of all vectors; ``None`` without vectors."""
    dim, _ = usual_length(df, column)
    n, sums = _sums(df, column, dim) if dim else (0, ())
    if not n:
        return None
    plain = Whitening(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0)
    middle, off = plain.middle, plain.rest / n

    def scatter(x: np.ndarray) -> np.ndarray:
        z = (x - middle).astype(np.float64)
        return z.T @ z

    cells = _summed(df, column, dim, scatter)
    centred = np.array([[cells[i, j] for j in range(dim)] for i in range(dim)]) - n * np.outer(off, off)
    rotated = one_sided_jacobi(pivoted_cholesky(centred))
    norms = np.sqrt((rotated * rotated).sum(axis=0))
    order = np.argsort(-norms, kind="stable")[:limit]
    return Whitening(n, sums, rotated[:, order] / norms[order], norms[order] ** 2 / n, float(np.trace(centred)) / n)


def identity_error(df: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, from the vectors themselves."""
    dim, k = model.components.shape
    if not k:
        return 0.0

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.project(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    cells = _summed(df, column, dim, moments)
    sums = np.array([[cells[i, j] for j in range(k)] for i in range(k + 1)]) / model.n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def _deviation(model: Whitening, x: np.ndarray) -> np.ndarray | list:
    """``sum((n x - S)^2)`` per row, exactly."""
    z, rest = x - model.middle, model.rest
    largest = model.n * int(np.abs(z).max(initial=0)) + int(np.abs(rest).max(initial=0))
    if len(rest) * largest * largest < 2**63:
        y = model.n * z - rest
        return (y * y).sum(axis=1)
    exact = [sum((model.n * a - b) ** 2 for a, b in zip(row, rest.tolist())) for row in z.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", limit: int = 32) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row per whole vector and component."""
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(df, column, limit)
    if model is None or not len(model.variances):
        return df.sparkSession.createDataFrame([], schema)
    error, (dim, k) = identity_error(df, model, column), model.components.shape
    names = [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = matrix(batch.column(1), dim)
            fits, x = integers(vectors)
            rows = rows[fits]
            for at in range(0, len(rows), ROWS_PER_BATCH):
                part = x[at : at + ROWS_PER_BATCH]
                m = len(part)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(rows[at : at + ROWS_PER_BATCH], k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, dtype=np.int64)),
                    pa.array(_deviation(model, part), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(model.project(part).ravel()),
                    pa.array(np.tile(model.variances / model.total, m)),
                    pa.array(np.full(m * k, error)),
                ], names)

    return df.select(F.col(id_column), as_doubles(column).alias("_vector")).mapInArrow(task, schema)
