"""Running values over groups of any size, and the ordered detectors that use them, against plain scans."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracehound.operators import ordered as O
from tracehound.operators.slices import SLICE, running, sliced


@pytest.mark.parametrize("forward,own", [(True, True), (True, False), (False, True), (False, False)])
def test_running_values_cross_slices(spark, forward, own):
    rng = random.Random(1)
    rows = [("hot" if i % 2 else rng.choice("abc"), i, rng.choice([None, 1, 5, -2])) for i in range(400)] + [(None, i, 1) for i in range(20)]
    df = sliced(spark.createDataFrame(rows, "k string, i int, v int").repartition(5), ["k"], ["i"], "test", 9)
    assert df.filter("k = 'hot'").select(SLICE).distinct().count() > 3
    out = running(df, ["k"], ["i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, forward, own).collect()
    assert len(out) == len(rows)
    for r in out:
        past = [v for k, i, v in rows if k == r["k"] and v is not None and ((i <= r["i"] if own else i < r["i"]) if forward else (i >= r["i"] if own else i > r["i"]))]
        assert (r["s"], r["m"]) == (sum(past), max(past, default=None))


def plain_bursts(times, window, least):
    found, i = [], 0
    while i < len(times):
        j = i
        while j < len(times) and times[j] - times[i] <= window:
            j += 1
        if j - i >= least:
            found.append((times[i], times[j - 1], j - i))
            i = j
        else:
            i += 1
    return found


def test_one_island_is_many_tasks(spark):
    """A group that never pauses, beside small ones, one without a name, and events without a time."""
    rng, start = random.Random(7), datetime(2024, 1, 1)
    rows, seconds = [], 0
    for i in range(4000):
        seconds += rng.choice([0, 1, 90, 140, 250])
        rows.append(("hot", start + timedelta(seconds=seconds), i))
    rows += [(rng.choice(["a", "b", None]), start + timedelta(seconds=rng.randrange(20_000)), i) for i in range(300)] + [("a", None, 1), (None, None, 2)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, i int").repartition(3)
    got = sorted(map(tuple, O.bursts(df, ["k"], "ts", "i", slices=11).collect()), key=str)
    wanted = []
    for k in ("hot", "a", "b", None):
        wanted += [(k, *b) for b in plain_bursts(sorted(t for h, t, _ in rows if h == k and t), timedelta(minutes=5), 3)]
    assert got == sorted(wanted, key=str) and len(got) > 500
    assert O.bursts(df.limit(0), ["k"], "ts", "i").count() == 0


def test_streaks_of_a_hot_account(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", None]), i, rng.choices(["fail", "ok", "other", None], [8, 1, 1, 1])[0]) for i in range(1500)]
    rows += [("long", i, "fail") for i in range(500)] + [("long", 500, "ok"), ("long", 501, "ok")]
    df = spark.createDataFrame(rows, "who string, at int, kind string").withColumn("tie", F.lit(0)).repartition(4)
    got = O.failures_then_success(df, "who", "at", "tie", F.col("kind") == "fail", F.col("kind") == "ok", 3, slices=13).collect()
    wanted, open_ = [], {}
    for who, at, kind in sorted(rows, key=lambda r: r[1]):
        if kind == "fail":
            open_[who] = open_.get(who, 0) + 1
            continue
        if kind == "ok" and open_.get(who, 0) >= 3:
            wanted.append((who, at, 0, open_[who]))
        open_[who] = 0
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str) and ("long", 500, 0, 500) in wanted


def test_first_of_each_without_a_limit_is_all(spark):
    df = spark.range(10).withColumn("k", F.lit(1))
    assert O.first_of_each(df, ["k"], ["id"], None).count() == 10 and O.first_of_each(df, ["k"], ["id"], 3).count() == 3


def test_small_tables_are_dealt_to_all_cores(spark, tmp_path):
    from tracehound.sources import staging

    spark.range(1000).repartition(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(9).write.parquet(str(tmp_path / "many"))
    one, many = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "many"))
    cores = spark.sparkContext.defaultParallelism
    assert staging.spread(one).rdd.getNumPartitions() == cores and staging.spread(one).count() == 1000
    assert staging.spread(many) is many or many.rdd.getNumPartitions() < cores


def test_backward_frames_are_not_folded_anew_for_each_row(spark):
    df = sliced(spark.range(50).withColumn("k", F.lit("a")), ["k"], ["id"], "test", 3)
    plan = running(df, ["k"], ["id"], {"m": ("min", F.col("id"))}, forward=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan.lower() and "unboundedfollowing" not in plan.lower()
