"""Bucketed tables: what a change rewrites, killed writers, versions."""
import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators import documents
from parley.sources.buckets import BUCKET, BucketedTable, Conflict

SCHEMA = T.StructType().add("doc_type", "string").add("source_id", "string").add("content", "string").add("created_at", "timestamp_ntz")
KEYS = ("doc_type", "source_id")
NOW = "timestamp_ntz '2024-01-31 00:00:00'"


def merge(current, incoming):
    return documents.upsert_documents(current, incoming, "version", now=F.expr(NOW))


def stored(spark, n=400):
    return spark.range(n).select(F.lit("doc").alias("doc_type"), F.col("id").cast("string").alias("source_id"),
                                 F.concat(F.lit("old "), "id").alias("content"),
                                 F.expr("timestamp_ntz '2024-01-01 00:00:00'").alias("created_at"))


def incoming(spark, ids, text="new"):
    return spark.createDataFrame([("doc", i, f"{text} {i}", 1) for i in ids], "doc_type string, source_id string, content string, version int")


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_type", "source_id", "content", "created_at").collect())


def files(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/data/**/*.parquet", recursive=True)}


@pytest.fixture
def table(spark, tmp_path):
    made = BucketedTable(spark, str(tmp_path / "t"), KEYS, SCHEMA)
    made.create(stored(spark), 32)
    return made


def test_a_change_rewrites_the_touched_buckets_only(spark, table):
    before, first = files(table.root), table.manifest()
    new = incoming(spark, ["3", "77", "added"])
    after = table.change(new, merge)
    touched = {r[0] for r in new.select(table._bucket(32)).collect()}
    assert 1 <= len(touched) <= 3 and first.buckets == 32 and first.rows == 400 and after.rows == 401
    written = files(table.root)
    assert {f: t for f, t in written.items() if f in before} == before  # nothing is changed in place
    assert {int(f.split(f"{BUCKET}=")[1].split("/")[0]) for f in set(written) - set(before)} == touched
    assert len(set(written) - set(before)) == len(touched)
    assert all(after.folders[b] == first.folders[b] for b in first.folders if b not in touched)
    assert rows(table.read()) == rows(merge(stored(spark), new))


def test_older_versions_stay(spark, table):
    table.change(incoming(spark, ["5"]), merge)
    assert rows(table.read(1)) == rows(stored(spark)) != rows(table.read(2)) == rows(table.read())
    with pytest.raises(ValueError):
        table.read(9)


def test_a_writer_killed_before_the_swap_changes_nothing(spark, table, monkeypatch):
    def killed(manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(table, "_swap", killed)
        with pytest.raises(KeyboardInterrupt):
            table.change(incoming(spark, ["1", "2"], "lost"), merge)
    assert len(glob.glob(f"{table.root}/data/commit=*")) == 2  # its files are there, and are not read
    assert rows(table.read()) == rows(stored(spark)) and table.manifest().version == 1
    table.change(incoming(spark, ["2"]), merge)
    assert rows(table.read()) == rows(merge(stored(spark), incoming(spark, ["2"])))


def test_the_second_of_two_writers_fails(spark, table, monkeypatch):
    old = table.manifest()
    table.change(incoming(spark, ["1"]), merge)
    with monkeypatch.context() as m:
        m.setattr(table, "manifest", lambda: old)  # it has read the table before the other's swap
        with pytest.raises(Conflict):
            table.change(incoming(spark, ["2"]), merge)
    assert rows(table.read()) == rows(merge(stored(spark), incoming(spark, ["1"])))


def test_a_change_may_be_repeated(spark, table):
    for _ in range(2):
        table.change(incoming(spark, ["1", "x"]), merge)
    content = {r.source_id: r.content for r in table.read().collect()}
    assert len(content) == 401 and content["x"] == "new x"


def test_lookup_reads_the_buckets_of_its_keys(spark, table):
    found = table.lookup(incoming(spark, ["8", "nowhere"]))
    assert [r.source_id for r in found.collect()] == ["8"]
    assert len(found.inputFiles()) <= 2


def test_empty_tables_missing_keys_and_emptied_buckets(spark, tmp_path):
    empty = BucketedTable(spark, str(tmp_path / "e"), ["k"], T.StructType().add("k", "integer").add("v", "string"))
    empty.create(spark.createDataFrame([], "k int, v string"), 4)
    assert empty.read().count() == 0 and empty.manifest().rows == 0
    nothing = spark.createDataFrame([], "k int, v string")
    assert empty.change(nothing, lambda old, new: new).version == 1
    one = spark.createDataFrame([(None, "n"), (1, "a")], "k int, v string")
    empty.change(one, lambda old, new: old.unionByName(new))
    assert sorted(r.v for r in empty.read().collect()) == ["a", "n"]
    assert [r.v for r in empty.lookup(one.where("k IS NULL")).collect()] == ["n"]
    empty.change(one, lambda old, new: old.limit(0))
    assert empty.read().count() == 0 and empty.manifest().folders == {} and empty.manifest().buckets == 4
