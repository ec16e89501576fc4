"""CSV and Parquet readers with declared schemas, and verified writers."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.operators.fingerprint import content_fingerprint, fingerprint_text, row_hash_sum
from stockweave.schema import FieldSpec, TableSpec
from stockweave.session import ensure_checkpoint_dir
from stockweave.sources.versions import delete, exists, move_if_absent

# Spellings that count as missing, true and false, and the number pattern.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
TRUE_TOKENS = ("true", "1", "yes", "y", "t")
FALSE_TOKENS = ("false", "0", "no", "n", "f")
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|Infinity)\s*$"
EXAMPLES_PER_COLUMN = 3


class IngestionError(ValueError):
    """A source does not match its declared schema."""


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def check_columns(found: list[str], spec: TableSpec, source: str) -> None:
    missing, extra = sorted(set(spec.names) - set(found)), sorted(set(found) - set(spec.names))
    if missing or extra:
        raise IngestionError(f"{source}: columns do not match {spec.schema_id} (missing {missing}, unexpected {extra})")


def null_tokens(text: Column) -> Column:
    return F.when(~text.isin(*NULL_TOKENS), text)


def convert_text(text: Column, spec: FieldSpec) -> Column:
    """Text to the logical type; null where the text does not convert."""
    if spec.dtype in ("int", "float"):
        number = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
        if spec.dtype == "float":
            return number
        # Whole numbers may be written as 3.0; long digit strings keep full precision.
        exact = text.try_cast("bigint")
        return F.coalesce(exact, F.when(number % 1 == 0, number.try_cast("bigint")))
    if spec.dtype == "bool":
        word = F.lower(F.trim(text))
        return F.when(word.isin(*TRUE_TOKENS), F.lit(True)).when(word.isin(*FALSE_TOKENS), F.lit(False))
    if spec.dtype in ("date", "datetime"):
        stamp = text.try_cast("timestamp_ntz")
        if spec.dtype == "datetime":
            return stamp
        day = stamp.cast("date")
        return F.when(stamp == day.cast("timestamp_ntz"), day)
    return text


def is_bad(text: Column, spec: FieldSpec) -> Column:
    return text.isNotNull() & convert_text(text, spec).isNull()


def bad_value_audit(text: DataFrame, spec: TableSpec) -> DataFrame:
    """``(column, bad_count, examples)`` per column: the three smallest distinct bad texts.

    Equal texts are counted together before the shuffle, and only the first three per column are
    carried into the window (Spark pushes the rank limit below the exchange).
    """
    flagged = [
        F.struct(F.lit(f.name).alias("column"), F.when(is_bad(F.col(f.name), f), F.col(f.name)).alias("text"))
        for f in spec.fields
    ]
    long = text.select(F.inline(F.array(*flagged))).where(F.col("text").isNotNull())
    counts = long.groupBy("column", "text").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(W.partitionBy("column").orderBy("text")))
    top = ranked.where(F.col("r") <= EXAMPLES_PER_COLUMN)
    examples = top.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]).alias("examples"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("bad_count"))
    names = text.sparkSession.createDataFrame([(f.name, i) for i, f in enumerate(spec.fields)], "column string, position int")
    joined = names.join(totals, "column", "left").join(examples, "column", "left")
    empty = F.array().cast(T.ArrayType(T.StringType()))
    return joined.select("column", F.coalesce("bad_count", F.lit(0)).cast("bigint").alias("bad_count"), F.coalesce("examples", empty).alias("examples"))


def type_text(text: DataFrame, spec: TableSpec) -> DataFrame:
    """Convert a table of text columns; any bad value fails the job when it is read."""
    columns = []
    for f in spec.fields:
        value = F.col(f.name)
        problem = F.concat(F.lit(f"column '{f.name}' has a value that is not a valid {f.dtype}: "), value)
        failed = F.raise_error(problem).cast(f.spark_type)
        columns.append(F.when(is_bad(value, f), failed).otherwise(convert_text(value, f)).alias(f.name))
    return text.select(*columns)


def read_csv_text(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """Every column as text, missing-value spellings as null; the header must match the schema."""
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    check_columns(header, spec, path)
    as_text = T.StructType([T.StructField(name, T.StringType()) for name in header])
    raw = spark.read.schema(as_text).option("header", True).option("enforceSchema", False).csv(path)
    return raw.select(*[null_tokens(F.col(name)).alias(name) for name in spec.names])


@dataclass(frozen=True)
class Ingested:
    """Typed rows, the rows with a bad value as the texts that were read, and the audit of these."""

    rows: DataFrame
    rejected: DataFrame
    report: DataFrame


def ingest_csv(spark: SparkSession, path: str, spec: TableSpec) -> Ingested:
    """Type a CSV source in one scan: rows are typed while they are copied to a staging folder, those with a bad value set aside.

    All bad values lie in the rows set aside, so their audit is that of the whole source and reads nothing else.
    """
    text = read_csv_text(spark, path, spec)
    bad = F.lit(False)
    for f in spec.fields:
        bad = bad | is_bad(F.col(f.name), f)
    typed = [F.when(~bad, convert_text(F.col(f.name), f)).cast(f.spark_type).alias(f"value_{i}") for i, f in enumerate(spec.fields)]
    texts = F.when(bad, F.struct(*spec.names))
    staging = scratch_path(spark, "typed")
    staged = text.select(*typed, texts.alias("texts"), bad.alias("bad"))
    staged.write.partitionBy("bad").parquet(staging)
    stored = spark.read.schema(staged.schema).parquet(staging)
    rows = stored.where("NOT bad").select(*[F.col(f"value_{i}").alias(name) for i, name in enumerate(spec.names)])
    rejected = stored.where("bad").select("texts.*")
    return Ingested(rows, rejected, bad_value_audit(rejected, spec))


def read_csv_typed(spark: SparkSession, path: str, spec: TableSpec, audit: bool = True) -> DataFrame:
    """Typed CSV read. With ``audit``, bad values are counted and reported together before any row is returned."""
    if not audit:
        return type_text(read_csv_text(spark, path, spec), spec)
    found = ingest_csv(spark, path, spec)
    bad = [r for r in found.report.collect() if r["bad_count"]]  # one row per column
    if bad:
        detail = "; ".join(f"column {r['column']!r}: {r['bad_count']} bad, e.g. {list(r['examples'])}" for r in bad)
        raise IngestionError(f"{path}: {detail}")
    return found.rows


def read_parquet_strict(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    df = spark.read.parquet(path)
    check_columns(df.columns, spec, path)
    return df.select(*spec.names)


def load_table(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """A CSV or Parquet table whose columns are exactly those of the schema."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv_typed(spark, path, spec)
    if suffix == "parquet":
        return read_parquet_strict(spark, path, spec)
    raise IngestionError(f"{path}: unsupported format {suffix!r} (use .csv or .parquet)")


def write_csv(df: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    """CSV with a header; the named float columns get a fixed number of decimals."""
    fixed = {c: F.format_string(f"%.{d}f", F.col(c)) for c, d in (decimals or {}).items()}
    df.withColumns(fixed).write.mode("errorifexists").option("header", True).csv(path)


def write_parquet_verified(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """``write_parquet_counted`` without the number of rows."""
    return write_parquet_counted(df, path, partition_by)[0]


def write_parquet_counted(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> tuple[str, int]:
    """Write to a staging folder, read back, compare fingerprints, and only then give it its name; fingerprint and rows.

    The row hashes are observed while the rows are written, so the input is computed once. A failed check leaves nothing at ``path``.
    """
    spark, seen = df.sparkSession, Observation()
    if exists(spark, path):
        raise IngestionError(f"{path} exists")
    head, _, tail = path.rstrip("/").rpartition("/")
    staging = f"{head}/_staging-{tail}-{uuid.uuid4().hex}"
    writer = df.observe(seen, F.count(F.lit(1)).alias("row_count"), row_hash_sum(df).alias("hash_sum")).write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
    stored = spark.read.schema(df.schema).parquet(staging).select(*df.columns)
    found = stored.agg(F.count(F.lit(1)).alias("row_count"), row_hash_sum(stored).alias("hash_sum")).first()
    if (found["row_count"], found["hash_sum"]) != (seen.get["row_count"], seen.get["hash_sum"]):
        delete(spark, staging)
        raise IngestionError(f"{path}: stored rows differ from the rows written")
    if not move_if_absent(spark, staging, path):
        delete(spark, staging)
        raise IngestionError(f"{path} exists")
    return fingerprint_text(df, found["row_count"], found["hash_sum"]), found["row_count"]


def read_verified(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """Load an artifact only when its rows still have the recorded fingerprint."""
    stored = spark.read.parquet(path)
    found = content_fingerprint(stored).first()["fingerprint"]
    if found != fingerprint:
        raise IngestionError(f"{path}: fingerprint {found} does not match the recorded {fingerprint}")
    return stored
