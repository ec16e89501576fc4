"""The training-corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.llm import linededup, minhash, pieces, quality, tiling
from stockweave.llm.queries import vocabulary
from stockweave.llm.registry import table
from stockweave.sources.files import scratch_path

#: The label model, MinHash, tiling and piece stages cannot be said in SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base test or that the label model holds for bad go."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the last of them only; ``n_chars`` follows the text."""
    done = linededup.dedup_lines(docs)
    changed = F.col(done.columns[-1]).getField("n_dropped") > 0
    out = done.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else done
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of smallest ``doc_id``. Documents without words are no group."""
    return minhash.drop_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return tiling.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids``: the ids as packed little-endian 32-bit integers; empty for a null text."""
    ids = F.coalesce(pieces.encode(F.col("text"), vocabulary("piece_bpe_32k.model")), F.lit(b""))
    coded = docs.select("doc_id", "lang", "source", ids.alias("ids"))
    return coded.select("doc_id", "lang", "source", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("piece encoding", piece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the intermediate tables lie below the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    root = scratch_path(spark, f"corpus-{uuid.uuid4().hex[:8]}")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/{k}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
