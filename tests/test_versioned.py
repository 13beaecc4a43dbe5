"""Versions of a table: readers in the middle of a swap, writers that die, two writers at once."""

import pytest
from pyspark.sql import functions as F

from cinderlens.sources.versioned import Conflict, VersionedTable

SCHEMA = "k string, v int"


@pytest.fixture
def table(spark, tmp_path):
    out = VersionedTable(spark, str(tmp_path / "t"), "k", buckets=8)
    out.merge(spark.createDataFrame([(f"k{i}", i) for i in range(200)], SCHEMA))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_reader_in_the_middle_of_a_swap(spark, table):
    reader = table.read()
    old = rows(reader)
    staged = table.stage(spark.createDataFrame([("k1", -1)], SCHEMA))
    # all new files are there, the manifest is not
    assert staged and rows(table.read()) == old and table.versions() == [1]
    assert table.merge(spark.createDataFrame([("k1", -1), ("new", 5)], SCHEMA)) == 2
    # the reader that had begun still sees its version whole, a new one the next
    assert rows(reader) == old
    assert rows(table.read()) == sorted([x for x in old if x[0] != "k1"] + [("k1", -1), ("new", 5)])
    assert rows(table.read(1)) == old


def test_a_writer_that_dies_changes_nothing(spark, table, monkeypatch):
    old = rows(table.read())
    monkeypatch.setattr(table, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped between the steps")))
    with pytest.raises(RuntimeError):
        table.merge(spark.createDataFrame([("k3", 0)], SCHEMA))
    monkeypatch.undo()
    assert rows(table.read()) == old
    # its files go with the next clean-up, and a later writer is not hindered
    assert table.vacuum() == 1
    assert rows(table.read()) == old and table.merge(spark.createDataFrame([("k3", 0)], SCHEMA)) == 2


def test_of_two_writers_one_has_to_merge_again(spark, table):
    manifest = table.manifest()
    table.merge(spark.createDataFrame([("x", 1)], SCHEMA))
    with pytest.raises(Conflict):
        table.commit({k: manifest[k] for k in ("schema", "files")}, 2)
    assert ("x", 1) in rows(table.read()) and table.versions() == [1, 2]


def test_only_touched_buckets_are_written(spark, table):
    before = table.manifest()["files"]
    table.merge(spark.createDataFrame([("k9", 90)], SCHEMA))
    after = table.manifest()["files"]
    assert sum(before[b] != after[b] for b in before) == 1 and before.keys() == after.keys()
    assert [r["v"] for r in table.get("k9").collect()] == [90]
    # of one key only its bucket's files are read
    assert len(table.get("k9").inputFiles()) == len(next(own for b, own in after.items() if before[b] != own))


def test_versions_that_no_one_needs_go(spark, table):
    for i in range(4):
        table.merge(spark.createDataFrame([("k9", i)], SCHEMA))
    table.vacuum(keep=2)
    assert table.versions() == [4, 5] and table.read().count() == 200
    assert rows(table.read(4).where(F.col("k") == "k9")) == [("k9", 2)]


def test_null_keys_and_no_rows(spark, tmp_path):
    out = VersionedTable(spark, str(tmp_path / "n"), "k", form="json")
    with pytest.raises(FileNotFoundError):
        out.read()
    out.merge(spark.createDataFrame([(None, 1), ("a", 2)], SCHEMA))
    out.merge(spark.createDataFrame([], SCHEMA))
    assert out.versions() == [1, 2] and out.read().count() == 2 and out.get(None).count() == 1
