"""Vectors in Arrow batches: which rows count, and their components as one matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(column: str) -> Column:
    """The vector column as ``array<double>``; floats widen exactly."""
    return F.col(column).cast("array<double>")


def split(array: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the length (-1 if null or if a component is null or not finite), the offset, and all components."""
    offsets = array.offsets.to_numpy().astype(np.int64)
    values = array.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    lengths = np.diff(offsets)
    lengths[(bad[offsets[1:]] > bad[offsets[:-1]]) | array.is_null().to_numpy(zero_copy_only=False)] = -1
    return lengths, offsets[:-1], values


def matrix(array: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the whole vectors of ``dim`` components, and these vectors."""
    lengths, starts, values = split(array)
    rows = np.flatnonzero(lengths == dim)
    return rows, values[starts[rows][:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0))


def usual_length(df: DataFrame, column: str) -> tuple[int, int]:
    """The most frequent length of whole vectors (the larger one of equals) and its rows; ``(0, 0)`` without any."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = np.unique(split(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(counts.astype(np.int64))], ["dim", "n"])

    counted = df.select(as_doubles(column).alias("v")).mapInArrow(lengths, "dim long, n long").where("dim > 0")
    first = counted.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).head(1)
    return (first[0]["dim"], first[0]["n"]) if first else (0, 0)
