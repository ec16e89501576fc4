import datetime

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
LONG = "word " * 30_000


@pytest.fixture
def docs(spark):
    """Builds ``documents`` from ``(doc_id, text)`` or ``(doc_id, text, lang)``."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] else 0) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture
def awkward(docs):
    """Nulls in every column, empty and very long texts, repeated rows and columns that clash with operators' names."""
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "\n \t"), (4, LONG), (None, "a b c d e f"), (5, "One line of words here.\nAnd more."), (5, "One line of words here.\nAnd more."), (6, "é" * 40)]
    made = docs(rows)
    clash = ("_measures", "_pattern", "_dropped", "_rewritten", "_doc", "_hits", "_gone", "line_dedup", "shard", "ids")
    return made.withColumns({c: F.lit(datetime.date(2024, 1, 1) if k % 2 else "x") for k, c in enumerate(clash)})
