"""Versioned tables: data is staged, read back and compared, and only then made visible by a numbered commit file.

A table folder holds ``data/<token>/part=<digest of the value>`` folders, which are written once and never changed, and ``log/<number>.json``
files that name the folders of one version with the digest of each partition. A commit file appears whole or not at all and only
if its number is free, so a reader sees the version before or the version after, and of two writers one retries. A write whose rows read
back differently leaves neither a commit nor its folder. A version that replaces one partition shares all other folders.

The digest of a partition is a count and two sums of 60-bit halves of the rows' MD5; sums add up to those of the table, so a
table's digest costs no further pass, and a changed file is traced to its partition by re-hashing that partition alone.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.operators.fingerprint import row_text

COMMIT = "number bigint, key string, value string, folder string, row_count bigint, low decimal(38,0), high decimal(38,0), schema string, parted_by string"
WHOLE = "whole"


class VersionError(RuntimeError):
    """Stored rows differ from the rows written, or the version asked for does not exist."""


class ConcurrentChange(VersionError):
    """Another writer has changed the same partition in the meantime."""


@dataclass(frozen=True)
class Part:
    key: str
    value: str | None
    folder: str
    row_count: int
    low: int
    high: int


@dataclass(frozen=True)
class Version:
    number: int
    parts: tuple[Part, ...]
    schema: T.StructType
    parted_by: str | None

    @property
    def digest(self) -> tuple[int, int, int]:
        """Rows and both sums of the whole table."""
        return sum(p.row_count for p in self.parts), sum(p.low for p in self.parts), sum(p.high for p in self.parts)


# --- files --------------------------------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    target, fs = _path(spark, path)
    fs.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, path)
    return fs.exists(target)


def move_if_absent(spark: SparkSession, source: str, target: str) -> bool:
    """Give ``source`` the name ``target`` in one step, unless that name is taken."""
    (old, fs), (new, _) = _path(spark, source), _path(spark, target)
    fs.mkdirs(new.getParent())
    jvm = spark._jvm
    try:
        if fs.getUri().getScheme() == "file" and fs.getFileStatus(old).isFile():
            # Renaming on a local disk replaces what is there; a second link to the same file does not.
            files = jvm.java.nio.file.Files
            files.createLink(jvm.java.io.File(new.toUri().getPath()).toPath(), jvm.java.io.File(old.toUri().getPath()).toPath())
            fs.delete(old, False)
            return True
        options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()).rename(old, new, options)
        return True
    except Py4JJavaError as failed:
        if "AlreadyExists" not in failed.java_exception.getClass().getName():
            raise
        return False


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with all its text, unless a file of that name exists."""
    target, fs = _path(spark, path)
    draft = f"{target.getParent().toString()}/.{uuid.uuid4().hex}.draft"  # hidden from readers of the folder
    stream = fs.create(_path(spark, draft)[0], False)
    stream.write(bytearray(text.encode()))
    stream.close()
    done = move_if_absent(spark, draft, path)
    if not done:
        delete(spark, draft)
    return done


def commit_file(root: str, number: int) -> str:
    return f"{root}/log/{number:012d}.json"


def read_log(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All commits; none before the first."""
    if not exists(spark, f"{root}/log"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{root}/log")


# --- digests ------------------------------------------------------------------------------------


def row_sums(df: DataFrame) -> list[Column]:
    """Aggregates ``row_count, low, high`` over the rows of ``df``."""
    digest = F.md5(row_text(df))
    lanes = [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 17)]
    return [F.count(F.lit(1)).alias("row_count"), *(F.coalesce(F.sum(lane), F.lit(0)).cast("decimal(38,0)").alias(n) for n, lane in zip(("low", "high"), lanes))]


def _value(df: DataFrame, parted_by: str | None) -> tuple[Column, Column]:
    """The partition's value as text, and the name of its folder."""
    if parted_by is None:
        return F.lit(None).cast("string"), F.lit(WHOLE)
    value = F.col(parted_by).cast("string")
    return value, F.coalesce(F.md5(value), F.lit("null"))


def _staged(df: DataFrame, root: str, parted_by: str | None) -> tuple[Part, ...]:
    """Write ``df`` below a folder of its own and compare what is read back with what was written."""
    spark, folder, seen = df.sparkSession, f"{root}/data/{uuid.uuid4().hex}", Observation()
    _, key = _value(df, parted_by)
    df.observe(seen, *row_sums(df)).withColumn("part", key).write.partitionBy("part").mode("errorifexists").parquet(folder)
    parts: tuple[Part, ...] = ()
    if seen.get["row_count"] or exists(spark, f"{folder}/part={WHOLE}"):
        stored = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("part", T.StringType())])).parquet(folder)
        value, _ = _value(stored, parted_by)
        found = stored.groupBy("part").agg(F.min(value).alias("value"), *row_sums(stored.drop("part"))).collect()  # a row per partition
        parts = tuple(Part(r["part"], r["value"], f"{folder}/part={r['part']}", r["row_count"], int(r["low"]), int(r["high"])) for r in found)
    written = seen.get["row_count"], int(seen.get["low"]), int(seen.get["high"])
    if Version(0, parts, df.schema, None).digest != written:
        delete(spark, folder)
        raise VersionError(f"{folder}: the rows read back differ from the rows written; nothing is published")
    return parts


# --- versions -----------------------------------------------------------------------------------


def versions(spark: SparkSession, root: str) -> DataFrame:
    """One row per version and partition."""
    return read_log(spark, root, COMMIT)


def version(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """The newest version, or the given one; ``None`` before the first."""
    log = versions(spark, root)
    if number is None:
        number = log.agg(F.max("number")).first()[0]
    rows = log.where(F.col("number") == number).orderBy("key").collect() if number is not None else []
    if not rows:
        return None
    parts = tuple(Part(r["key"], r["value"], r["folder"], r["row_count"], int(r["low"]), int(r["high"])) for r in rows if r["key"] is not None)
    return Version(number, parts, T.StructType.fromJson(json.loads(rows[0]["schema"])), rows[0]["parted_by"])


def _commit(spark: SparkSession, root: str, new: Version) -> bool:
    common = {"number": new.number, "schema": new.schema.json(), "parted_by": new.parted_by}
    lines = [json.dumps(common | asdict(p)) for p in new.parts] or [json.dumps(common)]
    return put_if_absent(spark, commit_file(root, new.number), "\n".join(lines))


def publish(df: DataFrame, root: str, parted_by: str | None = None) -> Version:
    """A new version with the rows of ``df`` and nothing else."""
    spark, parts = df.sparkSession, _staged(df, root, parted_by)
    last = version(spark, root)
    number = last.number + 1 if last else 1
    while not _commit(spark, root, new := Version(number, parts, df.schema, parted_by)):
        number += 1
    return new


def replace_part(df: DataFrame, root: str) -> Version:
    """A new version in which the partitions that ``df`` holds have its rows; all others keep their folders unread."""
    spark, base = df.sparkSession, version(df.sparkSession, root)
    if base is None or base.parted_by is None:
        raise VersionError(f"{root}: no partitioned table")
    staged = _staged(df.select(*base.schema.names), root, base.parted_by)
    keys, latest = {p.key for p in staged}, base
    while True:
        new = Version(latest.number + 1, (*(p for p in latest.parts if p.key not in keys), *staged), base.schema, base.parted_by)
        if _commit(spark, root, new):
            return new
        latest = version(spark, root)
        before, now = ({p.key: p.folder for p in v.parts if p.key in keys} for v in (base, latest))
        if latest.parted_by != base.parted_by or latest.schema != base.schema or before != now:
            for folder in {p.folder.rsplit("/", 1)[0] for p in staged}:
                delete(spark, folder)
            raise ConcurrentChange(f"{root}: version {latest.number} has changed the same partition")


def read(spark: SparkSession, root: str, number: int | None = None, values: list[str] | None = None) -> DataFrame:
    """The rows of a version; with ``values`` only those partitions are opened."""
    found = version(spark, root, number)
    if found is None:
        raise VersionError(f"{root}: no version {number or ''}".rstrip())
    folders = [p.folder for p in found.parts if values is None or p.value in values]
    return spark.read.schema(found.schema).parquet(*folders) if folders else spark.createDataFrame([], found.schema)


def audit(spark: SparkSession, root: str, number: int | None = None, values: list[str] | None = None) -> DataFrame:
    """``value, row_count, found_rows, intact`` per partition: which partitions no longer hold the rows that were committed."""
    found = version(spark, root, number)
    if found is None:
        raise VersionError(f"{root}: no version {number or ''}".rstrip())
    wanted = [p for p in found.parts if values is None or p.value in values]
    shape = "folder string, value string, row_count bigint, low decimal(38,0), high decimal(38,0)"
    recorded = spark.createDataFrame([(p.folder, p.value, p.row_count, Decimal(p.low), Decimal(p.high)) for p in wanted], shape)
    present = [p.folder for p in wanted if exists(spark, p.folder)]
    if not present:
        return recorded.select("value", "row_count", F.lit(0).cast("bigint").alias("found_rows"), (F.col("row_count") == 0).alias("intact"))
    stored = spark.read.schema(found.schema).parquet(*present)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/part=[^/]+)/[^/]+$", 1)
    sums = [c.alias(f"found_{n}") for c, n in zip(row_sums(stored), ("rows", "low", "high"))]
    digests = stored.withColumn("at", name).groupBy("at").agg(*sums)
    joined = recorded.join(digests, F.substring_index("folder", "/", -2) == F.col("at"), "left")
    same = F.col("row_count").eqNullSafe(F.col("found_rows")) & F.col("low").eqNullSafe(F.col("found_low")) & F.col("high").eqNullSafe(F.col("found_high"))
    return joined.select("value", "row_count", F.coalesce("found_rows", F.lit(0)).alias("found_rows"), same.alias("intact"))


def read_verified(spark: SparkSession, root: str, number: int | None = None, values: list[str] | None = None) -> DataFrame:
    """As ``read``, but refused when a partition has changed since its commit; the message names it."""
    changed = audit(spark, root, number, values).where("NOT intact").select("value").take(5)
    if changed:
        raise VersionError(f"{root}: changed since the commit: partition {', '.join(str(r['value']) for r in changed)}")
    return read(spark, root, number, values)
