"""Dataset registry, an append-only commit log, and provenance as plain tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockweave.schema import TableSpec
from stockweave.sources.files import read_verified, write_parquet_counted
from stockweave.sources.versions import commit_file, delete, exists, put_if_absent, read_log

REGISTRY_SCHEMA = (
    "seq bigint, dataset_id string, version string, schema_id string, source_type string, "
    "row_count bigint, fingerprint string, path string, metadata string"
)
PROVENANCE_SCHEMA = (
    "inputs array<struct<dataset_id:string,version:string,fingerprint:string>>, component string, component_version string, "
    "parameters map<string,string>, scenario_id string, seed bigint, steps array<string>, "
    "output_fingerprint string, output_rows bigint"
)
KEY = ("dataset_id", "version")


class DuplicateDataset(ValueError):
    """The (id, version) pair is registered already."""


def accepted_entries(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """New entries whose (id, version) is not registered yet."""
    return entries.join(registry.select(*KEY), list(KEY), "left_anti")


def _refuse(rows: list, what: str = "already registered") -> None:
    if rows:
        raise DuplicateDataset(f"{what}, for example: {[tuple(r) for r in rows]}")


def append_entries(entries: DataFrame, registry_path: str) -> int:
    """Append a batch in one commit and return its number; any registered (id, version) refuses the whole batch.

    Entries are written to a folder that no reader sees until the commit file names it. The commit takes the next free number;
    if another writer was first, only the entries committed meanwhile are compared, and the next number is tried.
    Entries without ``seq`` get the number of their commit.
    """
    spark, token = entries.sparkSession, uuid.uuid4().hex
    folder, last = f"{registry_path}/data/commit={token}", _commits(spark, registry_path).agg(F.max("number")).first()[0] or 0
    entries.write.parquet(folder)
    stored = spark.read.schema(entries.schema).parquet(folder)
    try:
        _refuse(stored.groupBy(*KEY).count().where("count > 1").select(*KEY).take(3), "twice in one batch")
        checked = 0
        while True:
            known = _committed(spark, registry_path).where(F.col("commit_number") > checked) if last else None
            if known is not None:
                _refuse(stored.join(known, list(KEY), "left_semi").select(*KEY).take(3))
            checked = last
            if put_if_absent(spark, commit_file(registry_path, last + 1), json.dumps({"number": last + 1, "commit": token})):
                return last + 1
            last = _commits(spark, registry_path).agg(F.max("number")).first()[0]
    except DuplicateDataset:
        delete(spark, folder)
        raise


def _commits(spark: SparkSession, registry_path: str) -> DataFrame:
    return read_log(spark, registry_path, "number bigint, commit string")


def _committed(spark: SparkSession, registry_path: str) -> DataFrame:
    """Entries of all commits with ``commit_number``; folders without a commit file are not there."""
    stored = spark.read.schema(f"{REGISTRY_SCHEMA}, commit string").parquet(f"{registry_path}/data")
    named = _commits(spark, registry_path).withColumnRenamed("number", "commit_number")
    return stored.join(named, "commit").withColumn("seq", F.coalesce("seq", "commit_number"))


def read_registry(spark: SparkSession, registry_path: str) -> DataFrame:
    """The registry table; empty before the first dataset is registered."""
    if not exists(spark, f"{registry_path}/log"):
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    return _committed(spark, registry_path).drop("commit", "commit_number")


def latest_entries(registry: DataFrame) -> DataFrame:
    """The most recently registered version of every id."""
    newest = F.row_number().over(W.partitionBy("dataset_id").orderBy(F.desc("seq")))
    return registry.withColumn("_r", newest).where("_r = 1").drop("_r")


def exact_entry(registry: DataFrame, dataset_id: str, version: str) -> DataFrame:
    return registry.where((F.col("dataset_id") == dataset_id) & (F.col("version") == version))


def list_entries(registry: DataFrame, source_type: str | None = None) -> DataFrame:
    chosen = registry if source_type is None else registry.where(F.col("source_type") == source_type)
    return chosen.orderBy("seq", *KEY)


def register_table(df: DataFrame, spec: TableSpec, dataset_id: str, version: str, source_type: str, root: str) -> str:
    """Store a table under ``root``, verify it and publish it by its registry row; a refused one leaves no data."""
    spark = df.sparkSession
    registry_path = f"{root}/registry"
    if exact_entry(read_registry(spark, registry_path), dataset_id, version).take(1):
        raise DuplicateDataset(f"already registered: {dataset_id} {version}")
    path = f"{root}/{dataset_id}/{version}"  # of two writers of one version, the first to verify gets this name
    fingerprint, rows = write_parquet_counted(df.select(*spec.names), path)
    entry = spark.range(1).select(
        F.lit(None).cast("bigint").alias("seq"), F.lit(dataset_id).alias("dataset_id"), F.lit(version).alias("version"),
        F.lit(spec.schema_id).alias("schema_id"), F.lit(source_type).alias("source_type"), F.lit(rows).cast("bigint").alias("row_count"),
        F.lit(fingerprint).alias("fingerprint"), F.lit(path).alias("path"),
        F.to_json(F.struct(F.lit(spec.version).alias("schema_version"), F.lit(spec.description).alias("description"))).alias("metadata"),
    )
    try:
        append_entries(entry, registry_path)
    except DuplicateDataset:
        delete(spark, path)
        raise
    return fingerprint


def load_registered(spark: SparkSession, root: str, dataset_id: str, version: str | None = None) -> DataFrame:
    """A registered table (latest version by default), refused when its rows have changed."""
    registry = read_registry(spark, f"{root}/registry")
    found = latest_entries(registry.where(F.col("dataset_id") == dataset_id)) if version is None else exact_entry(registry, dataset_id, version)
    entry = found.first()
    if entry is None:
        raise KeyError(f"not registered: {dataset_id} {version or ''}".strip())
    return read_verified(spark, entry["path"], entry["fingerprint"])


def provenance_json(provenance: DataFrame) -> DataFrame:
    """Provenance rows as JSON text next to their artifact key."""
    body = F.struct(*[c for c in provenance.columns if c not in KEY])
    return provenance.select(*KEY, F.to_json(body).alias("provenance"))


def parse_provenance(rows: DataFrame) -> DataFrame:
    parsed = F.from_json("provenance", PROVENANCE_SCHEMA)
    return rows.select(*KEY, parsed.alias("p")).select(*KEY, "p.*")


def lineage_edges(provenance: DataFrame) -> DataFrame:
    """One row per (artifact, input): id, version and pinned fingerprint of the input."""
    edge = provenance.select(*KEY, F.explode("inputs").alias("input"))
    return edge.select(
        *KEY,
        F.col("input.dataset_id").alias("input_id"),
        F.col("input.version").alias("input_version"),
        F.col("input.fingerprint").alias("pinned_fingerprint"),
    )


def drifted_edges(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Edges with a flag: the registered fingerprint is no longer the pinned one."""
    current = registry.select(F.col("dataset_id").alias("input_id"), F.col("version").alias("input_version"), F.col("fingerprint").alias("current_fingerprint"))
    joined = edges.join(current, ["input_id", "input_version"], "left")
    return joined.withColumn("drifted", ~F.col("pinned_fingerprint").eqNullSafe(F.col("current_fingerprint")))
