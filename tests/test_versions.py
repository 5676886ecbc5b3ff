"""Versioned tables: what appears when, what stays readable, which files are opened."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators.quarantine import QuarantineStore
from millrace.plans.model import TableHandle, TableSpec
from millrace.sources import versions
from millrace.sources.versions import Conflict, VersionedTable


class Items(TableSpec):
    source = "items"


@pytest.fixture
def url(spark, tmp_path):
    """A folder under a scheme that is not ``file``."""
    name = "m" + uuid.uuid4().hex
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./in", f"file://{tmp_path}")
    return f"viewfs://{name}/in/table"


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_versions_stay_readable(spark, url):
    made = VersionedTable(spark, url)
    with pytest.raises(FileNotFoundError):
        made.load()
    assert made.publish(spark.range(5)) == 5
    first = made.load()
    assert made.append(spark.range(5, 8)) == 3 and made.latest()["rows"] == 8 and made.latest()["bytes"] > 0
    assert made.publish(made.load().where("id % 2 = 0")) == 4
    assert (ids(first), ids(made.load()), ids(made.load(made.version(1)))) == (list(range(5)), [0, 2, 4, 6], list(range(8)))
    made.vacuum(0, keep=1)
    assert ids(made.load()) == [0, 2, 4, 6] and made.log.numbers() == [2] and len(made.log.fs.listStatus(made.log.path("data"))) == 1


@pytest.mark.parametrize("cut", ["write", "bounds", "commit"])
def test_a_cut_off_writer_leaves_the_table(spark, url, monkeypatch, cut):
    made = VersionedTable(spark, url)
    made.publish(spark.range(5), ["id"])

    def die(*_):
        raise KeyboardInterrupt

    if cut == "write":
        df = spark.range(9).select(F.raise_error(F.lit("cut off")).cast("long").alias("id"))
    else:
        df = spark.range(9)
        monkeypatch.setattr(VersionedTable if cut == "bounds" else versions.Versions, "read" if cut == "bounds" else "commit", die)
    with pytest.raises((Exception, KeyboardInterrupt)):
        made.publish(df, ["id"])
    monkeypatch.undo()
    assert ids(made.load()) == list(range(5)) and made.latest()["version"] == 0
    assert len(made.log.fs.listStatus(made.log.path("data"))) == 1  # nothing is left of it


def test_writers_side_by_side(spark, url):
    made = VersionedTable(spark, url)
    made.publish(spark.range(1))
    seen = made.latest()
    threads = [threading.Thread(target=lambda i=i: VersionedTable(spark, url).append(spark.range(i, i + 1))) for i in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert ids(made.load()) == list(range(5)) and made.latest()["version"] == 4
    with pytest.raises(Conflict):
        made.publish(made.load(seen), onto=seen)
    with pytest.raises(ValueError, match="columns"):
        made.append(spark.range(3).withColumnRenamed("id", "other"))
    assert ids(made.load()) == list(range(5))


def test_a_scan_opens_the_files_that_may_hold_its_rows(spark, url, monkeypatch):
    made = VersionedTable(spark, url)
    made.publish(spark.range(0, 1000, 1, 100).withColumn("n", F.when(F.col("id") >= 10, F.col("id") % 7)), ["id", "n"])
    made.append(spark.range(1000, 1010).withColumn("n", F.lit(3).cast("long")))
    found = made.scan({"id": (503, 506)})
    assert ids(found) == [503, 504, 505, 506] and len(found.inputFiles()) == 1
    assert ids(made.scan({"id": (995, None), "n": (3, 3)})) == [i for i in range(995, 1010) if i >= 1000 or i % 7 == 3]
    assert ids(made.scan({"id": (None, 9), "n": (None, None)})) == []  # null is in no range
    assert ids(made.scan({"id": (5000, None)})) == []
    monkeypatch.setattr(versions, "MOST_FILES", 3)
    assert ids(made.scan({"id": (500, 599)})) == list(range(500, 600))


def test_odd_columns_and_empty_tables(spark, url):
    made = VersionedTable(spark, url)
    assert made.publish(spark.createDataFrame([], "`a b` string, file long"), ["a b", "file"]) == 0
    assert made.load().columns == ["a b", "file"] and made.scan({"a b": ("x", None)}).count() == 0
    made.append(spark.createDataFrame([("é", 1), (None, None)], "`a b` string, file long"))
    assert made.load().count() == 2 and made.scan({"a b": ("a", None)}).first()["file"] == 1


def test_a_run_s_table_on_another_file_system(spark, url, tmp_path):
    handle = TableHandle(spark, Items(), tmp_path / "items", tmp_path, tmp_path / "items")
    assert handle.save_at(url, spark.range(10), ["id"]) == 10 and handle.row_count() == 10 and not handle.is_large()
    store = QuarantineStore(spark, tmp_path)
    assert store.keep_snapshot("s", "items", handle.active) and not store.keep_snapshot("s", "items", handle.active)
    store.add("s", "items", handle.load().where("id > 7"), "too large")
    assert handle.sink(handle.load().where("id <= 7")) == 8 and handle.versions.latest()["bounded"] == ["id"]
    store.merge("s", "items", handle.active)
    assert ids(handle.load()) == list(range(10)) and store.read("s", "items") is None
    with pytest.raises(ValueError, match="URL"):
        handle.save_at("/x", handle.load())
