"""Rules, ordered operators, lineage, findings, redaction, triage and sources on hand-made rows."""

import io
import json
import random
import tarfile
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracehound.functions import scalars as S
from tracehound.operators import findings as fi
from tracehound.operators import lineage as L
from tracehound.operators import ordered as O
from tracehound.operators import redaction as X
from tracehound.operators import rules as U
from tracehound.operators import triage as T
from tracehound.operators.components import connected_components
from tracehound.sources import avlog, collection, content

RULES = """
title: Encoded
logsource: {category: process_creation}
detection:
  selection: {Image|endswith: '\\powershell.exe', CommandLine|contains: [' -enc ', ' -e ']}
  filter: {User: SYSTEM}
  condition: selection and not filter
level: high
tags: [attack.t1059.001]
---
title: Dump
logsource: {category: process_creation}
detection: {Sel_A: {CommandLine|contains|all: [comsvcs.dll, MiniDump]}, Sel_B: {CommandLine: null, EventID: 4104}, condition: 1 of Sel*}
level: critical
---
title: Count
detection: {s: {a: b}, condition: s | count() > 5}
---
title: None
detection: {s: {a: b}}
"""


def test_rule_pack(spark):
    rules, left = U.load_rules(RULES)
    assert [r.title for r in rules] == ["Encoded", "Dump"] and left == {"empty": 0, "no condition": 1, "aggregation": 1, "noise": 0}
    assert rules[0].technique == "T1059.001" and rules[0].applies_to("pslist") and not rules[0].applies_to("dns")
    rows = [
        (0, {"Image": "C:\\X\\PowerShell.exe", "CommandLine": "p -enc x"}), (1, {"Exe": "C:/x/powershell.exe", "cmdline": "p -e y", "User": "SYSTEM"}), (2, {"CommandLine": "rundll32 COMSVCS.dll, minidump"}), (3, {"EventID": "4104"}), (4, {"other": "x"}),
    ]
    df = spark.createDataFrame(rows, "i int, row map<string,string>")
    got = {(r["i"], r["rule"]) for r in U.scan(df, rules, "pslist", raw="row", keep=("i",)).collect()}
    assert got == {(0, "Encoded"), (2, "Dump")}
    assert U.scan(df, rules, "dns", raw="row", keep=("i",)).count() == 0


@pytest.mark.parametrize("network,inside,outside", [("10.0.0.0/8", "10.255.1.2", "11.0.0.0"), ("192.168.4.0/22", "192.168.7.255", "192.168.8.0"), ("1.2.3.4", "1.2.3.4", "1.2.3.5")])
def test_networks(spark, network, inside, outside):
    df = spark.createDataFrame([(inside,), (outside,), (None,), ("x",)], "a string")
    assert [r[0] for r in df.select(U.in_network(F.col("a"), network)).collect()] == [True, False, False, False]


def test_bursts_equal_the_sequential_scan(spark):
    random.seed(4)
    base, rows = datetime(2024, 1, 1), []
    for host in "abc":
        at = 0
        for i in range(150):
            at += random.choice([5, 40, 100, 200, 400])
            rows.append((host, base + timedelta(seconds=at), i))
    df = spark.createDataFrame(rows, "host string, ts timestamp_ntz, i int")
    got = sorted((r["host"], r["burst_start"], r["burst_end"], r["n"]) for r in O.bursts(df, ["host"], "ts", "i").collect())
    wanted = []
    for host in "abc":
        own, i = [t for h, t, _ in rows if h == host], 0
        while i < len(own):
            j = i
            while j < len(own) and own[j] - own[i] <= timedelta(minutes=5):
                j += 1
            if j - i >= 3:
                wanted.append((host, own[i], own[j - 1], j - i))
                i = j
            else:
                i += 1
    assert got == sorted(wanted)


def test_ancestry_cycles_and_depth(spark):
    rows = [("h", "1", "0", "winword.exe", 0), ("h", "2", "1", "cmd.exe", 1), ("h", "3", "2", "powershell.exe", 2), ("h", "8", "9", "a", 3), ("h", "9", "8", "b", 4), ("h", "7", "7", "self", 5)]
    rows += [("d", str(i), str(i - 1), f"p{i}", i) for i in range(30)]
    df = spark.createDataFrame(rows, "host string, pid string, ppid string, name string, row_index int")
    chains = L.ancestry(df, ["host"])
    got = {(r["host"], r["leaf"]): list(r["names"]) for r in chains.collect()}
    assert got[("h", "3")] == ["winword.exe", "cmd.exe", "powershell.exe"] and got[("h", "7")] == ["self"] and got[("h", "9")] == ["a", "b"]
    assert got[("d", "29")] == [f"p{i}" for i in range(17, 30)]
    trees = {r["leaf"]: r["label"] for r in L.process_trees(chains.filter("host = 'h'")).collect()}
    assert trees["3"] == "winword.exe > cmd.exe" or trees["3"].startswith("winword.exe > ")


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (10, 11), (5, 5)] + [(i, i + 1) for i in range(100, 160)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {i: 100 for i in range(100, 161)}


def test_dedup_keeps_the_number_of_findings(spark):
    rows = [("t", i % 3, i, f"f{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "title string, k int, row_index long, source_file string").withColumns({"category": F.lit("c"), "severity": F.lit("low"), "mitre": F.lit(None).cast("string"), "artifact": F.col("k").cast("string")})
    out = fi.dedup(df).collect()
    assert sum(r["occurrences"] for r in out) == 40 and {r["row_index"] for r in out} == {0, 1, 2}
    assert all(len(r["occurrence_locators"]) == 10 for r in out)


def test_severity_and_time(spark):
    df = spark.createDataFrame([("critical", "2024-01-01T10:00:00+02:00"), ("bogus", "2024-01-01 10:00:00"), ("Info", "nothing")], "s string, t string")
    got = df.select(S.severity_rank(F.col("s")), S.parse_time(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(0, datetime(2024, 1, 1, 8)), (2, datetime(2024, 1, 1, 10)), (4, None)]


def test_redaction_round_trip_and_exemptions(spark):
    texts = ["mail bob@corp.example from 10.1.2.3 and 127.0.0.1", "C:\\Users\\alice\\x and bob@corp.example", None, "nothing here"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    hidden, mapping = X.redact(df, "i", "text")
    shown = {r["i"]: r["redacted"] for r in hidden.collect()}
    assert "bob@" not in shown[0] and "127.0.0.1" in shown[0] and "10.1.2.3" not in shown[0] and "alice" not in shown[1] and shown[2] is None and shown[3] == texts[3]
    back = {r["i"]: r["restored"] for r in X.restore(hidden.select("i", "redacted"), "i", "redacted", mapping).collect()}
    assert back == dict(enumerate(texts))
    assert X.merge_mappings(mapping, mapping).count() == mapping.count()


def test_triage_upsert(spark):
    old = spark.createDataFrame([("F1", "benign", None, 1), ("F2", "false_positive", "n", 1)], "finding_id string, verdict string, note string, updated_at int")
    new = spark.createDataFrame([("F1", None, "seen", 2)], old.schema)
    out = {r["finding_id"]: (r["verdict"], r["note"]) for r in T.upsert(old, new, "finding_id", fill=("verdict", "note")).collect()}
    assert out == {"F1": ("benign", "seen"), "F2": ("false_positive", "n")}
    findings = spark.createDataFrame([("F1",), ("F2",)], "id string")
    assert [r["id"] for r in T.without_false_positives(findings, old).collect()] == ["F1"]


def test_collections(spark, tmp_path):
    (tmp_path / "pslist.json").write_text(json.dumps([{"Pid": 1, "x": {"y": 2}}, {"Pid": 2}]))
    (tmp_path / "one.json").write_text('{"a": 1}')
    (tmp_path / "net.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    rows = collection.read_collection(spark, str(tmp_path)).collect()
    assert sorted((r["artifact"], r["row_index"], r["row"].get("Pid") or r["row"].get("a")) for r in rows) == [("net", 0, "1"), ("net", 1, "2"), ("one", 0, "1"), ("pslist", 0, "1"), ("pslist", 1, "2")]
    assert {r["row"].get("raw") for r in collection.read_jsonl(spark, str(tmp_path), tolerant=True).collect()} == {None, "broken"}
    table = tmp_path / "t" / "export.csv"
    table.parent.mkdir()
    table.write_text("time;message\n1;failed\n2;ok\n")
    assert [r["row"] for r in collection.read_csv(spark, str(table)).collect()] == [{"time": "1", "message": "failed"}, {"time": "2", "message": "ok"}]
    log = tmp_path / "l" / "auth.log"
    log.parent.mkdir()
    log.write_text("Jan  1 10:00:00 h sshd: x\n\nplain\n")
    assert [(r["artifact"], r["row"]["timestamp"]) for r in collection.read_text(spark, str(log)).collect()] == [("authlog", "Jan  1 10:00:00"), ("authlog", "")]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("results/Windows.System%2EPslist.json", '{"Pid": 1}\n{"Pid": 2}\n')
        z.writestr("t.csv", "a,b\n1,2\n")
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as t:
        data = b'[{"q": "x"}]'
        info = tarfile.TarInfo("dns.json")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    rows = collection.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r["artifact"], r["row_index"]) for r in rows) == [("Windows_System_Pslist", 0), ("Windows_System_Pslist", 1), ("dns", 0), ("t", 0)]


def test_av_log_lines(spark):
    lines = ["2021-07-22T15:38:04.557Z DETECTION_ADD Ransom:Win32/Conti.ZA file:C:\\ProgramData\\badfile.exe", "Engine:EMS detection: HackTool:Win64/CobaltStrike.A!!CobaltStrike.A64, sigseq=0x1, pid=6108", "2020-06-14T20:11:42.880Z ProcessImageName: explorer.exe, TotalTime: 30, Count: 11, MaxTime: 15, MaxTimeFile: \\Device\\x\\PuTTY.lnk->, EstimatedImpact: 9%", "noise"]
    files = spark.createDataFrame([("m.log", lines, None), ("bad.log", ["x"], "denied")], "filename string, lines array<string>, error string")
    events, counts = avlog.expand_logs(files)
    got = {r["event_type"]: r for r in events.collect()}
    assert got["detection"]["file"] == "C:\\ProgramData\\badfile.exe" and got["ems_detection"]["pid"] == "6108" and got["estimated_impact"]["max_time_file"] == "\\Device\\x\\PuTTY.lnk" and counts.count() == 3


def test_content_scan(spark, tmp_path):
    (tmp_path / "a.ps1").write_bytes("sekurlsa::logonpasswords MIMIKATZ".encode("utf-16-le"))
    (tmp_path / "b.txt").write_text("all your files are safe")
    (tmp_path / "c.php").write_text("<?php eval($_POST['x']);")
    # Larger than one task's part, the strings in parts of their own, one of them in two bytes a character.
    lines = [b"\xff\xfe\x00 filler " * 8 + b"\n" for _ in range(3000)]
    lines[100], lines[2900] = b"\x80LSADUMP\x00\n", "kerberos::".encode("utf-16-le") + b"\n"
    (tmp_path / "d.dll").write_bytes(b"".join(lines))
    (tmp_path / "e.txt").write_bytes(b"beacon.dll \n %s AS %s\\%s: %d %%import%%")
    (tmp_path / "f.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        files = content.read_files(spark, str(tmp_path))
        assert files.filter(F.col("path").endswith("d.dll")).select("block").distinct().count() > 3
        rows = {r["filename"].rsplit("/", 1)[1]: (r["rule"], r["matched_strings"]) for r in content.scan_files(files).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == {"a.ps1": ("SUSP_Mimikatz_Strings", ["sekurlsa", "MIMIKATZ"]), "c.php": ("SUSP_Webshell_Common_Patterns", ["eval($_POST"]), "d.dll": ("SUSP_Mimikatz_Strings", ["LSADUMP", "kerberos::"])}
    df = spark.createDataFrame([("a.exe", 0), ("a.exe", 60 << 20), ("a.exe", 5)], "path string, length long")
    assert [df.filter(content.scannable(F.col("path"), F.col("length"), most)).count() for most in (content.MOST_BYTES, None)] == [1, 2]


def test_hash_feed_and_audit(spark, tmp_path):
    feed = tmp_path / "f.txt"
    feed.write_text(f"# x\n{'a' * 64} one\n{'A' * 64},two\nshort,y\n")
    assert [tuple(r) for r in collection.read_hash_feed(spark, str(feed)).collect()] == [("a" * 64, "two")]
    path = str(tmp_path / "audit")
    for i in range(3):
        collection.append_audit(spark.createDataFrame([(i, "e" if i else "f")], "ts int, event string"), path)
    assert [r["ts"] for r in collection.read_audit(spark, path, "e").collect()] == [2, 1]
    assert {r["event"]: r["n"] for r in collection.audit_totals(spark, path).collect()} == {"e": 2, "f": 1}
