"""Timeline bursts, rare values and the entity graph on hand-made rows."""

from pyspark.sql import functions as F

from tracehound.operators import correlation as C
from tracehound.operators.detectors import processes as detect
from tracehound.operators.graph import trim
from tracehound.sources.canonical import canonical
from tracehound.sources.collection import SCHEMA


def test_correlation(spark):
    rows = [("h", "pslist", i, "f", {"Pid": str(i), "Ppid": str(i - 1), "Name": n, "Exe": p, "User": "bob", "sha256": s, "create_time": f"2024-01-01T10:0{i}:00Z"}) for i, (n, p, s) in enumerate([("winword.exe", "C:\\x\\winword.exe", "1"), ("powershell.exe", "C:\\Users\\b\\AppData\\Local\\odd\\powershell.exe", "2"), ("svchost.exe", "C:\\Windows\\System32\\svchost.exe", "3"), ("svchost.exe", "C:\\Windows\\System32\\svchost.exe", "4")])]
    rows += [("h", "netstat", 0, "f", {"remote": "8.8.8.8:443", "State": "ESTABLISHED", "pid": "1", "timestamp": "2024-01-01T10:02:30Z"}), ("h", "netstat", 1, "f", {"remote": "10.0.0.1:443", "pid": "1"}), ("h", "dns", 0, "f", {"domain": "Rare.example"}), ("h", "registry", 0, "f", {"key": "HKLM\\Run", "value": "C:\\x\\powershell.exe -x"})]
    df = spark.createDataFrame(rows, SCHEMA)
    of = lambda artifact, family: canonical(df.filter(F.col("artifact") == artifact), family)
    p, n, d = of("pslist", "process"), of("netstat", "network"), of("dns", "dns")
    found = detect(p).cache()
    burst = C.timeline_bursts(C.timeline(df, found)).collect()
    assert len(burst) == 1 and burst[0]["n"] == 5 and burst[0]["artifacts"] == ["netstat", "pslist"] and burst[0]["severity"] == "medium"
    assert [r["title"] for r in C.rare_paths(p).collect()] == ["Rare program path: powershell.exe"]
    assert {r["title"] for r in C.rare_endpoints(n, d).collect()} == {"Rare remote endpoint: 8.8.8.8", "Rare remote endpoint: rare.example"}
    assert [r["title"] for r in C.hash_mismatches(p).collect()] == ["System program with several hashes: svchost.exe"]
    nodes, edges = C.entity_graph(p, n, d, of("registry", "registry"), of("tasks", "task"), of("services", "service"), found)
    kinds = {r["type"] for r in nodes.collect()}
    assert kinds == {"process", "user", "ip", "domain", "registry_key", "file"}
    rels = {(r["source"], r["target"], r["rel"]) for r in edges.collect()}
    assert ("process:h/0", "process:h/1", "spawned") in rels and ("process:h/1", "ip:8.8.8.8", "connected") in rels and ("process:h/1", "registry_key:h/HKLM\\Run", "created") in rels and ("user:bob", "process:h/3", "ran") in rels
    kept, inside = trim(nodes, edges, 3)
    assert kept.count() == 3 and kept.filter("finding_count > 0").count() >= 1 and inside.count() <= edges.count()
