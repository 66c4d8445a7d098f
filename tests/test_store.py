"""A keyed store changes the buckets of changed keys only, and versions stay whole."""

import os

import pytest
from pyspark.sql import functions as F

from tracehound.sources.store import ChangedMeanwhile, KeyedStore


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path / "data") for n in names if n.endswith(".parquet")}


@pytest.fixture
def store(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("updated_at"), F.lit("old").alias("v"))
    return KeyedStore.create(spark, str(tmp_path / "s"), rows, "k", 16)


def test_only_changed_buckets_are_written(spark, tmp_path, store):
    before, m = files(tmp_path / "s"), store.manifest()
    assert store.upsert(spark.createDataFrame([("7", 2, "new"), ("900", 2, "more")], "k string, updated_at int, v string")) == 2
    after, now = files(tmp_path / "s"), store.manifest()
    assert {f: t for f, t in after.items() if f in before} == before
    moved = {b for b in now.folders if now.folders[b] != m.folders.get(b)}
    assert 1 <= len(moved) <= 2 and len(after) - len(before) == len(moved)
    rows = {r["k"]: r["v"] for r in store.read().collect()}
    assert len(rows) == 401 and rows["7"] == "new" and rows["900"] == "more" and rows["8"] == "old"
    assert [r["v"] for r in store.get("7").collect()] == ["new"] and store.read(version=1).filter("k = '7'").first()["v"] == "old"


def test_older_rows_do_not_win_and_new_columns_come_in(spark, store):
    store.upsert(spark.createDataFrame([("1", 0, "late", 5)], "k string, updated_at int, v string, note int"))
    store.upsert(spark.createDataFrame([("2", 3, "x", 6)], "k string, updated_at int, v string, note int"))
    rows = {r["k"]: (r["v"], r["note"]) for r in store.read().filter("k in ('1', '2', '3')").collect()}
    assert rows == {"1": ("old", None), "2": ("x", 6), "3": ("old", None)}


def test_delete_and_forget(spark, tmp_path, store):
    keys = store.read().select("k")
    assert store.delete(keys.filter("cast(k as int) % 2 = 0").unionByName(spark.createDataFrame([("none",)], "k string"))) == 2
    assert store.read().count() == 200 and store.read(version=1).count() == 400
    gone = store.forget()
    assert gone and store.versions() == [2] and store.read().count() == 200
    store.delete(store.read().select("k"))
    assert store.read().count() == 0 and store.read().columns == ["k", "updated_at", "v"]


def test_a_second_writer_of_a_version_fails(spark, store):
    m = store.manifest()
    store.delete(spark.createDataFrame([("1",)], "k string"))
    with pytest.raises(ChangedMeanwhile):
        store._change(m, spark.createDataFrame([("2",)], "k string"), lambda old: old.filter("k <> '2'"), m.schema)
    assert store.read().filter("k in ('1', '2')").count() == 1


def test_an_empty_change_makes_an_equal_version(spark, store):
    empty = spark.createDataFrame([], "k string, updated_at int, v string")
    assert store.upsert(empty) == 2 and store.manifest().folders == store.manifest(1).folders
