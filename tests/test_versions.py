"""Versioned tables: whole versions, lost jobs, conflicts, batches that run again, garbage."""

import json
import pathlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from loomspark.sources import stored
from loomspark.sources.versions import Conflict, VersionedTable
from loomspark.streaming import jobs

SCHEMA = "id int, word string, bucket int"


def _rows(table):
    return sorted(tuple(r) for r in table.collect())


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "bucket")


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_versions_stand_side_by_side(spark, table):
    assert table.version() == 0 and table.read().count() == 0 and not pathlib.Path(table.path).exists()
    assert table.commit(_df(spark, [(1, "a", 0), (2, "b", 1), (3, "c", 2)])) == 1
    one = table.read()
    assert table.commit(table.read().where("bucket = 1").withColumn("word", F.lit("B")), [1, 2]) == 2  # 2 becomes empty
    assert _rows(table.read()) == [(1, "a", 0), (2, "B", 1)]
    assert _rows(one) == _rows(table.read(1)) == [(1, "a", 0), (2, "b", 1), (3, "c", 2)]
    assert _rows(table.read(buckets=[1, 9])) == [(2, "B", 1)] and table.read(buckets=[]).count() == 0
    assert table.commit(_df(spark, [])) == 3 and _rows(table.read()) == [(1, "a", 0), (2, "B", 1)]
    with pytest.raises(Exception, match="without a bucket"):
        table.commit(_df(spark, [(1, "a", None)]))
    assert table.version() == 3


@pytest.mark.parametrize("step", ["write", "listed", "create", "rename"])
def test_a_job_that_dies_leaves_the_old_version(spark, table, monkeypatch, step):
    """Killed before, while or after the data are written, and while the manifest is put in place."""
    table.commit(_df(spark, [(1, "a", 0), (2, "b", 1)]))

    class Died(BaseException):
        pass

    def die(*_, **__):
        raise Died

    with monkeypatch.context() as m:
        if step == "write":
            m.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", die)
        elif step == "listed":
            m.setattr(table, "_listed", lambda folder, real=table._listed: die() if folder.startswith("data") else real(folder))
        elif step == "create":
            m.setattr(table, "_publish", die)
        else:
            m.setattr("loomspark.sources.versions.json", SimpleNamespace(dumps=die, loads=json.loads))  # the draft is there, and empty
        with pytest.raises(Died):
            table.commit(_df(spark, [(9, "z", 1)]), [1])
    assert _rows(table.read()) == [(1, "a", 0), (2, "b", 1)] and table.version() == 1
    assert table.commit(_df(spark, [(9, "z", 1)]), [1]) == 2 and _rows(table.read()) == [(1, "a", 0), (9, "z", 1)]
    left = 1 if step in ("listed", "create", "rename") else 0
    assert table.collect_garbage(keep=2, seconds=3600) == 0
    assert table.collect_garbage(keep=2, seconds=-10) == left and _rows(table.read(1)) == [(1, "a", 0), (2, "b", 1)]
    assert table.collect_garbage(keep=1, seconds=-10) == 0 and table.versions() == [2]  # bucket 0 still lies in the first folder
    table.commit(_df(spark, [(1, "new", 0)]), [0])
    assert table.collect_garbage(keep=1, seconds=-10) == 1 and _rows(table.read()) == [(1, "new", 0), (9, "z", 1)]


def test_two_jobs_from_one_version(spark, table):
    table.commit(_df(spark, [(1, "a", 0)]))
    table.commit(_df(spark, [(2, "b", 1)]), parent=1)
    with pytest.raises(Conflict):
        table.commit(_df(spark, [(3, "c", 2)]), parent=1)
    assert _rows(table.read()) == [(1, "a", 0), (2, "b", 1)]
    table.commit(_df(spark, [(3, "c", 2)]), parent=table.version())
    assert len(_rows(table.read())) == 3


def test_a_batch_counts_once(spark, table):
    assert table.commit(_df(spark, [(1, "a", 0)]), query="q", batch=0) == 1
    assert table.commit(_df(spark, [(1, "again", 0)]), query="q", batch=0) == 1
    assert table.commit(_df(spark, [(2, "b", 1)]), query="other", batch=0) == 2
    assert _rows(table.read()) == [(1, "a", 0), (2, "b", 1)] and table.manifest()["batches"] == {"q": 0, "other": 0}


def test_an_index_batch_that_dies_and_runs_again(spark, tmp_path, monkeypatch):
    """Between the commit and the end of the micro-batch: the batch runs again and adds no version."""
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "vec"), str(tmp_path / "cp")
    files = "source_key string, text string, last_modified timestamp"
    put = lambda rows: spark.createDataFrame(rows, "source_key string, text string").withColumn("last_modified", F.current_timestamp()).coalesce(1).write.mode("append").parquet(src)
    go = lambda: jobs.stream_index(spark.readStream.schema(files).parquet(src), out, cp, "fixed-64-16", "m").awaitTermination(120)
    put([("a.txt", "x " * 200), ("b.txt", "y " * 30)])
    real = VersionedTable.commit

    def dies(self, *a, **k):
        real(self, *a, **k)
        raise RuntimeError("lost after the commit")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "commit", dies)
        with pytest.raises(Exception, match="lost after the commit"):
            go()
    table = jobs.index_table(spark, out)
    first = _rows(table.read().select("vector_id", "content"))
    assert table.version() == 1 and first
    go()
    assert table.version() == 1 and _rows(table.read().select("vector_id", "content")) == first
    put([("a.txt", "z")])
    go()
    assert table.version() == 2 and _rows(table.read(1).select("vector_id", "content")) == first
    assert {r.source_key for r in table.read().collect()} == {"a.txt", "b.txt"}


def test_extractions_are_versions(spark, tmp_path):
    path, schema = str(tmp_path / "e"), "document_id string, text string"
    assert stored.save_extractions(spark.createDataFrame([("a", "1"), ("b", "2")], schema), path, 2) == 1
    assert stored.save_extractions(spark.createDataFrame([("a", "new"), ("c", "3")], schema), path, 2) == 2
    table = stored.extractions_table(spark, path, schema)
    assert sorted((r.document_id, r.text) for r in table.read().collect()) == [("a", "new"), ("b", "2"), ("c", "3")]
    assert sorted((r.document_id, r.text) for r in table.read(1).collect()) == [("a", "1"), ("b", "2")]
