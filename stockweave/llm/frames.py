"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import inspect
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that a checkpoint has replaced.

    Spark deletes them once the driver's JVM has collected their plans, which may otherwise be long after the job.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return freed memory to the system: Python workers serve one stage after another, and allocators keep what they once had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(fn: Callable) -> Callable:
    """``fn``, a function that runs in Python workers, giving back its memory when it returns or, an iterator, when it ends."""
    if inspect.isgeneratorfunction(fn):

        @wraps(fn)
        def streamed(*args):
            try:
                yield from fn(*args)
            finally:
                give_back()

        return streamed

    @wraps(fn)
    def called(*args):
        try:
            return fn(*args)
        finally:
            give_back()

    return called
