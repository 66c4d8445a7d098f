"""Report sections, hunting and streaming on hand-made rows and the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from tracehound.operators import ordered as O
from tracehound.operators import report
from tracehound.operators.findings import emit, identity, in_order
from tracehound.operators.hunt import Hunt
from tracehound.sources.collection import SCHEMA
from tracehound.streaming.detectors import failure_streaks, windowed_threshold, write_findings

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def findings(spark):
    rows = [(i, f"C:\\ProgramData\\BadTool{'' if i < 4 else i}\\x.exe" if i < 8 else f"C:\\e{i}", "T1219" if i in (20, 50) else "", ["low", "high", "critical"][i % 3]) for i in range(55)]
    df = spark.createDataFrame(rows, "row_index long, path string, technique string, severity string").withColumns({"artifact": F.lit("a"), "host": F.lit("h")})
    return identity(emit(df, "process_anomaly", F.col("severity"), F.concat(F.lit("t"), F.col("row_index").cast("string")), "d", 50, F.col("technique"), {"path": F.col("path")})).cache()


def test_batches(findings):
    out = report.batches(findings, 20).toPandas()
    assert sorted(out["id"]) == sorted(r["id"] for r in findings.collect()) and out.groupby("batch").size().max() <= 20
    titles = {r["id"]: r["title"] for r in findings.collect()}
    batch = {titles[i]: b for i, b in zip(out["id"], out["batch"])}
    assert batch["t20"] == batch["t50"] and len({batch[f"t{i}"] for i in range(4)}) == 1


def test_clusters_and_sections(findings, tmp_path):
    folders = report.folder_clusters(findings)
    assert folders.collect()[0]["n"] == 4
    assert report.tool_clusters(findings, folders).collect()[0]["n"] == 8
    m = report.bottom_line(report.metrics(findings)).first()
    assert m["findings"] == 55 and m["critical"] == 18 and m["bottom_line"].startswith("Act now")
    report.write_sections(report.sections(findings, findings.groupBy("artifact").count()), str(tmp_path))
    assert os.path.isdir(tmp_path / "techniques")
    first = in_order(findings).first()
    assert first["severity"] == "critical"
    assert findings.select(report.evidence_fields(F.col("evidence")).alias("e")).first()["e"][0]["label"] == "Path"


def test_hunt(spark, findings):
    rows = spark.createDataFrame([("h", "pslist", i, "f", {"Name": f"p{i}", "x": "needle" if i == 3 else ""}) for i in range(10)] + [("h", "dns", 0, "f", {"q": "needle"})], SCHEMA)
    hunt = Hunt(rows, findings)
    assert [tuple(r) for r in hunt.artifacts().collect()] == [("pslist", 10), ("dns", 1)]
    assert hunt.search("NEEDLE").count() == 2 and hunt.slice("pslist", 2, 3).count() == 3
    got = hunt.frequency("needle").first()
    assert (got["n"], got["artifacts"], got["class"]) == (2, ["dns", "pslist"], "rare")
    one = hunt.find("critical", "process", 5).collect()
    assert len(one) == 5 and hunt.finding(one[0]["id"]).count() == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the supplied tables")
def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    events.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    auth = lambda df: df.filter(F.col("event_type").isin("error", "purchase", "signup"))
    found = failure_streaks(auth(stream), "user_id", "ts", "event_id", F.col("event_type") == "error", 2)
    q = write_findings(found, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {(r["account"], r["tie"], r["failures"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = O.failures_then_success(auth(events), "user_id", "ts", "event_id", F.col("event_type") == "error", F.col("event_type") != "error", 2)
    assert got == {(r["user_id"], r["event_id"], r["failures"]) for r in batch.collect()} and got
    counted = windowed_threshold(stream.filter("event_type = 'error'"), "ts", ["user_id"], 1, "1 day", "1 hour")
    q = write_findings(counted, str(tmp_path / "out2"), str(tmp_path / "ck2"))
    q.awaitTermination()
    n = sum(r["n"] for r in spark.read.parquet(str(tmp_path / "out2")).collect())
    assert 0 < n <= events.filter("event_type = 'error'").count()
