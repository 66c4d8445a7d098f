"""Readers of large files by many tasks, against plain parsing."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracehound.sources import collection
from tracehound.sources.json_objects import json_objects

VALUES = ["plain", 'quote " inside', "brace } and {", "back\\slash", 'mixed \\" } "', "line\nend", "[1, 2]", "é \U0001f600", ""]


def value(rng, depth=0):
    kind = rng.random()
    if kind < 0.5 or depth > 2:
        return rng.choice(VALUES)
    if kind < 0.65:
        return {rng.choice(VALUES): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))] if kind < 0.8 else rng.choice([1, -2.5, None, True])


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent", [None, 2])
def test_an_array_in_many_splits(spark, tmp_path, small_splits, indent):
    rng = random.Random(indent or 0)
    items = [rng.choice([{"i": i, "v": value(rng)}, {"i": i, "v": value(rng)}, rng.choice(VALUES), 7]) for i in range(400)]
    (tmp_path / "a.b.json").write_text(json.dumps(items, indent=indent, ensure_ascii=False))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    rows = sorted(collection.read_json(spark, str(tmp_path)).collect(), key=lambda r: r["row_index"])
    objects = [x for x in items if isinstance(x, dict)]
    assert [r["row_index"] for r in rows] == list(range(len(objects))) and {r["artifact"] for r in rows} == {"a_b"}
    for r, x in zip(rows, objects):
        assert int(r["row"]["i"]) == x["i"]
        v = r["row"]["v"]
        assert v == x["v"] if isinstance(x["v"], str) else (v is None if x["v"] is None else json.loads(v) == x["v"])


def test_other_layouts(spark, tmp_path):
    (tmp_path / "one.json").write_text('\ufeff {\n "a": {"b": "}"}\n}\n')
    (tmp_path / "lines.json").write_text('{"a": 1}\nbroken {\n\n{"a": {"b": 2}}\n{"a": 3}\n')
    (tmp_path / "two.json").write_text('{"a": {"x": 1}}\n{"a": 2}')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "text.json").write_text('["only } text {"]')
    (tmp_path / "cut.json").write_text('[{"a": 1}, {"a": {"b": 2}')
    got = {}
    for r in collection.read_json(spark, str(tmp_path)).collect():
        got.setdefault(r["artifact"], {})[r["row_index"]] = r["row"]["a"]
    assert got == {"one": {0: '{"b":"}"}'}, "lines": {0: "1", 1: '{"b":2}', 2: "3"}, "two": {0: '{"x":1}', 1: "2"}, "cut": {0: "1"}}
    _, by_line = json_objects(spark, str(tmp_path))
    assert sorted(r[0].rsplit("/", 1)[1] for r in by_line.collect()) == ["lines.json", "two.json"]


def test_lines_are_numbered_by_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "auth.log").write_text("".join(f"line {i}\n" + "\n" * (i % 3) for i in range(3000)))
    (tmp_path / "other.log").write_text("x\ny\n")
    rows = collection.read_text(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    by = {}
    for r in rows.collect():
        by.setdefault(r["artifact"], {})[r["row_index"]] = r["row"]["raw"]
    assert by == {"authlog": {i: f"line {i}" for i in range(3000)}, "textlog": {0: "x", 1: "y"}}


def test_files_of_one_name_are_kept_apart(spark, tmp_path):
    for folder, n in (("a", 1), ("b", 2), ("c", 3)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "Win.Ps.json").write_text(json.dumps([{"n": n}]))
    (tmp_path / "a" / "Win.Ps.jsonl").write_text('{"n": 4}\n')
    got = {(r["artifact"], r["row"]["n"]) for r in collection.read_collection(spark, str(tmp_path)).collect()}
    assert got == {("Win_Ps", "1"), ("Win_Ps_b", "2"), ("Win_Ps_c", "3"), ("Win_Ps_a", "4")}


def test_no_files_give_no_rows(spark, tmp_path):
    (tmp_path / "x.json").write_text(" \n")
    assert collection.read_json(spark, str(tmp_path)).count() == 0
    assert collection.read_jsonl(spark, str(tmp_path)).select(F.col("row_index")).count() == 0


def test_a_path_is_read_once_for_each_list(spark):
    from pyspark.sql import functions as F

    from tracehound.functions.tables import SCANNABLE_EXTENSIONS, SECURITY_SOFTWARE_PATHS
    from tracehound.sources.content import scannable

    paths = [f"/a/{i}{e.upper()}" for i, e in enumerate(SCANNABLE_EXTENSIONS)] + [f"/x{p}y{SCANNABLE_EXTENSIONS[0]}" for p in SECURITY_SOFTWARE_PATHS] + ["/a/b.nothing", "/a/b" + SCANNABLE_EXTENSIONS[0] + "\n", "/a/b" + SCANNABLE_EXTENSIONS[0][1:].replace(".", "x")]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", scannable(F.col("p"), F.lit(5)).alias("ok"))

    def plain(p):
        low = p.replace("/", "\\").lower()
        return p.lower().endswith(tuple(SCANNABLE_EXTENSIONS)) and not any(s.replace("/", "\\") in low for s in SECURITY_SOFTWARE_PATHS)

    assert {r["p"]: r["ok"] for r in df.collect()} == {p: plain(p) for p in paths}
    assert df._jdf.queryExecution().analyzed().toString().count("lower(") <= 3


def test_a_split_is_many_slices(spark, tmp_path, small_splits, monkeypatch):
    from tracehound.sources import json_objects as J

    monkeypatch.setattr(J, "SLICE_CHUNKS", 5)
    rng = random.Random(5)
    for name in ("a", "b"):
        items = [{"i": i, "v": value(rng)} for i in range(300)]
        (tmp_path / f"{name}.json").write_text(json.dumps(items, ensure_ascii=False))
        (tmp_path / f"{name}_lines.json").write_text("".join(json.dumps({"i": i}) + "\n" for i in range(40)))
    chunks = J._chunks(spark, str(tmp_path), "*.json")
    assert chunks.groupBy("source_file", "block", J.SLICE).count().agg(F.max("count")).first()[0] <= 5
    # Slices are in the order of the splits.
    assert chunks.groupBy("source_file", J.SLICE).agg(F.count_distinct("block").alias("n")).filter("n > 1").isEmpty()
    got = {}
    for r in collection.read_json(spark, str(tmp_path)).collect():
        got.setdefault(r["artifact"], {})[r["row_index"]] = int(r["row"]["i"])
    assert got == {n: {i: i for i in range(k)} for n, k in (("a", 300), ("b", 300), ("a_lines", 40), ("b_lines", 40))}
