"""Versioned tables, staged writes and the registry's commit log under faults and races."""

import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from stockweave.schema import CANONICAL
from stockweave.sources import files, registry, versions

SHAPE = "store string, day int, units bigint"
ROWS = [("A", 1, 5), ("A", 2, 6), ("B", 1, 7), (None, 3, 8), ("C/x", 9, None)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(ROWS, SHAPE)


def test_versions_share_unchanged_partitions(spark, sales, tmp_path):
    root = str(tmp_path / "sales")
    first = versions.publish(sales, root, "store")
    assert rows(versions.read(spark, root)) == sorted(ROWS, key=str) and first.number == 1
    assert rows(versions.read(spark, root, values=["A"])) == [("A", 1, 5), ("A", 2, 6)]
    second = versions.replace_part(spark.createDataFrame([("A", 1, 50)], SHAPE), root)
    old, new = ({p.value: p.folder for p in v.parts} for v in (first, second))
    assert {v for v in old if old[v] != new[v]} == {"A"} and second.digest[0] == 4
    assert rows(versions.read(spark, root)) == sorted([("A", 1, 50), *ROWS[2:]], key=str)
    assert rows(versions.read(spark, root, number=1)) == sorted(ROWS, key=str)
    with pytest.raises(versions.VersionError, match="no version 7"):
        versions.read(spark, root, number=7)


def test_digests_add_up_and_do_not_depend_on_the_partitioning(spark, sales, tmp_path):
    whole, parted = versions.publish(sales, str(tmp_path / "a")), versions.publish(sales.repartition(4), str(tmp_path / "b"), "store")
    assert whole.digest == parted.digest and len(whole.parts) == 1 and len(parted.parts) == 4
    changed = versions.publish(sales.withColumn("units", F.col("units") + 1), str(tmp_path / "c"))
    assert changed.digest[0] == 5 and changed.digest[1:] != whole.digest[1:]


def test_a_changed_partition_is_named_and_read_alone(spark, sales, tmp_path):
    root = str(tmp_path / "sales")
    version = versions.publish(sales, root, "store")
    assert versions.read_verified(spark, root).count() == 5
    folder = next(p.folder for p in version.parts if p.value == "B")
    spark.createDataFrame([("B", 1, 8)], SHAPE).write.mode("append").parquet(folder)
    assert {r["value"]: r["intact"] for r in versions.audit(spark, root).collect()} == {"A": True, "B": False, None: True, "C/x": True}
    with pytest.raises(versions.VersionError, match="partition B$"):
        versions.read_verified(spark, root)
    assert versions.read_verified(spark, root, values=["A"]).count() == 2
    versions.delete(spark, folder)
    assert [r["value"] for r in versions.audit(spark, root).where("NOT intact").collect()] == ["B"]


def test_a_failed_check_leaves_nothing(spark, sales, tmp_path, monkeypatch):
    shifting = sales.withColumn("units", F.floor(F.rand() * 1e15))  # another value each time it is computed
    stored = versions._staged
    root, path = str(tmp_path / "t"), str(tmp_path / "plain.parquet")
    versions.publish(sales, root)
    read = type(spark.read).parquet

    def spoilt(self, *paths):
        df = read(self, *paths)
        return df.withColumn("units", F.lit(1).cast("bigint")) if any("data/" in p or "_staging" in p for p in paths) else df

    monkeypatch.setattr(type(spark.read), "parquet", spoilt)
    with pytest.raises(versions.VersionError, match="nothing is published"):
        stored(shifting, root, None)
    with pytest.raises(versions.VersionError, match="nothing is published"):
        versions.publish(shifting, root)
    with pytest.raises(files.IngestionError, match="differ"):
        files.write_parquet_verified(shifting, path)
    monkeypatch.undo()
    assert not os.path.exists(path) and glob.glob(str(tmp_path / "_staging*")) == []
    assert len(os.listdir(f"{root}/data")) == 1 and rows(versions.read(spark, root)) == sorted(ROWS, key=str)


def test_verified_writes_do_not_replace(spark, sales, tmp_path):
    path = str(tmp_path / "x.parquet")
    files.write_parquet_verified(sales, path, partition_by=("day",))
    with pytest.raises(files.IngestionError, match="exists"):
        files.write_parquet_verified(sales, path)
    assert spark.read.parquet(path).count() == 5 and glob.glob(str(tmp_path / "_staging*")) == []


def test_empty_tables(spark, sales, tmp_path):
    for k, by in enumerate((None, "store")):
        root = str(tmp_path / str(k))
        assert versions.publish(sales.limit(0), root, by).digest == (0, 0, 0)
        assert versions.read_verified(spark, root).schema == sales.schema and versions.read(spark, root).count() == 0
    filled = versions.replace_part(sales.where("store = 'A'"), str(tmp_path / "1"))
    assert [p.value for p in filled.parts] == ["A"]


def raced(work):
    """Run the jobs at once; what each returned or raised."""
    results, gate = {}, threading.Barrier(len(work))

    def one(name, job):
        gate.wait()
        try:
            results[name] = job()
        except Exception as failed:  # the caller asserts on it
            results[name] = failed

    threads = [threading.Thread(target=one, args=item) for item in work.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return results


def test_only_one_of_many_creates_a_file(spark, tmp_path):
    path = str(tmp_path / "log" / "000000000001.json")
    done = raced({k: lambda k=k: versions.put_if_absent(spark, path, f"writer {k}\n" * 500) for k in range(8)})
    won = [k for k, made in done.items() if made is True]
    assert len(won) == 1 and open(path).read() == f"writer {won[0]}\n" * 500
    assert [n for n in os.listdir(tmp_path / "log") if "draft" in n and not n.endswith(".crc")] == []


def test_concurrent_partition_changes(spark, sales, tmp_path):
    root = str(tmp_path / "sales")
    versions.publish(sales, root, "store")
    new = {s: spark.createDataFrame([(s, 1, 100)], SHAPE) for s in ("A", "B")}
    done = raced({s: lambda s=s: versions.replace_part(new[s], root) for s in new})
    assert sorted(v.number for v in done.values()) == [2, 3]
    assert {(r["store"], r["units"]) for r in versions.read(spark, root).where("store IN ('A', 'B')").collect()} == {("A", 100), ("B", 100)}
    clash = raced({k: lambda k=k: versions.replace_part(new["A"].withColumn("units", F.lit(k).cast("bigint")), root) for k in (1, 2)})
    lost = [k for k, v in clash.items() if isinstance(v, versions.ConcurrentChange)]
    numbers = [v.number for v in clash.values() if not isinstance(v, Exception)]
    assert (len(lost), numbers) == (1, [4]) or (lost == [] and sorted(numbers) == [4, 5])  # one after the other is no conflict


ENTRY = "dataset_id string, version string, schema_id string, source_type string, row_count bigint, fingerprint string, path string, metadata string, seq bigint"


def entry(spark, name, version="1"):
    return spark.createDataFrame([(name, version, "s", "derived", 1, "f", "p", "{}", None)], ENTRY)


def test_concurrent_appends_get_different_numbers(spark, tmp_path):
    path = str(tmp_path / "registry")
    done = raced({n: lambda n=n: registry.append_entries(entry(spark, n), path) for n in ("a", "b", "c", "d")})
    assert sorted(done.values()) == [1, 2, 3, 4]
    assert {(r["dataset_id"], r["seq"]) for r in registry.read_registry(spark, path).collect()} == set(done.items())


def test_concurrent_duplicates_are_refused(spark, tmp_path):
    path = str(tmp_path / "registry")
    registry.append_entries(entry(spark, "other"), path)
    done = raced({k: lambda: registry.append_entries(entry(spark, "same"), path) for k in range(3)})
    assert sum(isinstance(v, registry.DuplicateDataset) for v in done.values()) == 2
    assert sorted(r["dataset_id"] for r in registry.read_registry(spark, path).collect()) == ["other", "same"]
    assert len(glob.glob(f"{path}/data/commit=*")) == 2
    with pytest.raises(registry.DuplicateDataset, match="twice"):
        registry.append_entries(entry(spark, "x").union(entry(spark, "x")), path)


def test_uncommitted_entries_are_invisible(spark, tmp_path):
    path = str(tmp_path / "registry")
    registry.append_entries(entry(spark, "a"), path)
    entry(spark, "crashed").write.parquet(f"{path}/data/commit=0123abc")
    assert [r["dataset_id"] for r in registry.read_registry(spark, path).collect()] == ["a"]
    assert registry.append_entries(entry(spark, "crashed"), path) == 2


def test_a_refused_table_leaves_no_data(spark, tmp_path):
    root, spec = str(tmp_path / "lake"), CANONICAL["retail.region"]
    table = spark.createDataFrame([("CA", "California")], "region_id string, name string")
    done = raced({k: lambda: registry.register_table(table, spec, "region", "1", "reference", root) for k in range(2)})
    assert sorted(isinstance(v, Exception) for v in done.values()) == [False, True]
    assert registry.load_registered(spark, root, "region").count() == 1
    assert os.listdir(f"{root}/region") == ["1"] or sorted(n for n in os.listdir(f"{root}/region") if not n.startswith("_")) == ["1"]
