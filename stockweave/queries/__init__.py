"""Registered queries: one Spark function and, where SQL can say it, one DuckDB statement each."""

from __future__ import annotations

from stockweave.queries.registry import ORACLES, QUERIES
from stockweave.queries import (  # noqa: F401  (importing fills the registry)
    aggregates,
    canonical,
    forecasting,
    joins,
    ledger,
    planning,
    quality,
    reshape,
    scalars,
    sources,
    synthesis,
    windows,
)

__all__ = ["ORACLES", "QUERIES"]
