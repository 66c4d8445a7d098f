"""Each family's detectors on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tracehound.operators import findings as fi
from tracehound.operators.detectors import DETECTORS, Engine, generic, hash_reputation, network, processes
from tracehound.operators.textlogs import text_logs
from tracehound.sources.canonical import canonical, family_of, routed
from tracehound.sources.collection import SCHEMA

CASES = [
    ("pslist", [{"Pid": "1", "Name": "winword.exe"}, {"Pid": "2", "Ppid": "1", "Name": "powershell.exe", "Exe": "C:\\Temp\\powershell.exe", "CommandLine": "powershell -enc QUJDREVGR0hJSktMTU5PUFFSU1Q="}, {"Pid": "3", "Name": "svchost.exe", "Exe": "C:\\Users\\x\\svchost.exe"}],
     {"Suspicious parent-child: winword.exe > powershell.exe", "Suspicious process command: PowerShell encoded command", "Process from suspicious location: Running from Temp", "Process masquerading: svchost.exe"}),
    ("netstat", [{"remote": "1.2.3.4:4444", "State": "ESTABLISHED"}] * 5 + [{"remote_address": "9.9.9.9", "remote_port": "31337"}], {"Connection to suspicious port 4444", "Connection to suspicious port 31337", "Potential beaconing to 1.2.3.4"}),
    ("dns_queries", [{"name": "xkqzjvwprtbnmd.example.org"}, {"domain": "a" * 55 + ".evil.net"}] + [{"domain": f"h{i}.bad.com", "rcode": "NXDOMAIN"} for i in range(10)], {"Generated-looking domain: xkqzjvwprtbnmd.example.org", "Very long DNS label: evil.net", "NXDOMAIN burst: bad.com"}),
    ("services", [{"Name": "a", "PathName": "C:\\Program Files\\My App\\svc.exe"}, {"Name": "b", "PathName": "\"C:\\Windows\\Temp\\x.exe\""}], {"Unquoted service path", "Service binary in suspicious location"}),
    ("scheduledtasks", [{"Name": "t", "action": "cmd.exe", "Arguments": "/c vssadmin delete shadows"}], {"Scheduled task with suspicious command: Shadow copy deletion", "Scheduled task with suspicious command: Shadow copy deletion (ransomware)"}),
    ("evtx_security", [{"EventID": "1102", "Channel": "Security"}, {"id": "4720"}, {"EventID": "7045", "d": "powershell -enc abc"}] + [{"EventID": "4625", "IpAddress": "10.1.1.9"}] * 5, {"Security audit log cleared", "New user account created", "New service installed", "Possible brute-force from 10.1.1.9"}),
    ("eventlog_auth", [{"EventID": "4625", "TargetUserName": "bob", "time": f"2024-01-01T23:0{i}:00Z"} for i in range(5)] + [{"EventID": "4624", "TargetUserName": "bob", "LogonType": "10", "time": "2024-01-01T23:10:00Z"}], {"Successful logon for 'bob' after 5 failed attempts", "Off-hours privileged logon for 'bob'", "Possible brute-force from unknown"}),
    ("eventlog_defender", [{"EventID": "1116", "x": "Trojan:Win32/Foo.A"}, {"EventID": "5001"}], {"Windows Defender detected: Trojan:Win32/Foo.A", "Windows Defender real-time protection disabled"}),
    ("sysmon", [{"EventID": "10", "SourceImage": "C:\\x\\evil.exe", "TargetImage": "C:\\Windows\\System32\\lsass.exe", "CallTrace": "UNKNOWN(1)"}, {"EventID": "17", "PipeName": "\\msagent_12", "Image": "a.exe"}, {"EventID": "3", "Image": "C:\\W\\certutil.exe", "DestinationIp": "8.8.8.8", "DestinationPort": "443"}, {"EventID": "25", "Image": "b.exe", "Type": "hollow"}],
     {"Sysmon: lsass.exe memory access by 'evil.exe'", "Sysmon: suspicious named pipe (Cobalt Strike default pipe)", "Sysmon: LOLBin 'certutil.exe' made a network connection", "Sysmon: process tampering detected (hollow)"}),
    ("registry_autoruns", [{"location": "HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run", "value": "C:\\Users\\Public\\x.exe -w hidden"}], {"Suspicious registry value: Hidden window", "Registry autorun from suspicious path"}),
    ("lnk_files", [{"target": "mshta http://x"}], {"Shortcut with suspicious target: MSHTA remote/script"}),
    ("shimcache", [{"path": "C:\\Temp\\a.pdf.exe"}], {"Shimcache: Executed from Temp", "Shimcache: double-extension masquerade executed"}),
    ("mft_metadata", [{"FullPath": "C:\\Temp\\a.pdf.exe"}], {"Double extension file (masquerading)", "Executable in suspicious location"}),
    ("mplog_events", [{"event_type": "estimated_impact", "process": "rclone.exe", "files_accessed": "50000", "max_time_file": "\\\\srv\\share\\x"}], {"MPLog: rclone.exe accessed many files of a network share"}),
    ("yara", [{"rule": "SUSP_Mimikatz_Strings", "severity": "critical", "filename": "C:\\x"}], {"Content rule match: SUSP_Mimikatz_Strings"}),
    ("something", [{"a": "sekurlsa::logonpasswords"}], {"Suspicious content: Mimikatz/credential dumping"}),
    ("authlog", [{"raw": "Failed password for root from 1.1.1.1 port 22"}, {"line": "modprobe x"}], {"SSH brute-force / failed password", "Kernel module load/unload"}),
    ("apache_access", [{"raw": '1.1.1.1 - - [10/Oct/2000:13:55:36 -0700] "GET /../etc/passwd HTTP/1.1" 200 12'}, {"raw": '1.1.1.1 - - [10/Oct/2000:13:55:36 -0700] "GET /ok HTTP/1.1" 200 12'}], {"HTTP 200 GET /../etc/passwd"}),
    ("suricata", [{"raw": '{"event_type":"alert","src_ip":"1.1.1.1","alert":{"signature":"ET SCAN x","severity":2}}'}], {"Suricata: ET SCAN x"}),
    ("zeek_conn", [{"raw": "#fields\tts\tid.orig_h\tid.resp_h\tid.resp_p\tproto\torig_bytes"}, {"raw": "1\t1.1.1.1\t2.2.2.2\t4444\ttcp\t5"}, {"raw": "1\t1.1.1.1\t2.2.2.2\t443\ttcp\t5"}], {"Zeek: suspicious connection 1.1.1.1>2.2.2.2:4444"}),
    ("siem_export", [{"message": "Login failed", "severity": "warning"}, {"message": "ok"}], {"Login failed"}),
]


@pytest.fixture(scope="module")
def placed(spark):
    rows = [("h", artifact, i, "f", row) for artifact, rows, _ in CASES for i, row in enumerate(rows)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("family", family_of(F.col("artifact"))).cache()


@pytest.mark.parametrize("family", sorted({*DETECTORS, "textlog", "generic"} - {"execution", "userassist", "shellbags"}))
def test_titles(placed, family):
    rows = placed.filter(F.col("family") == family)
    found = [detect(canonical(rows, family)) for detect in DETECTORS.get(family, [])] or [{"textlog": text_logs, "generic": generic}[family](rows)]
    titles = {}
    for df in found:
        for r in df.collect():
            titles.setdefault(r["artifact"], set()).add(r["title"])
    assert titles
    wanted = {artifact: t for artifact, _, t in CASES}
    assert not {artifact: wanted[artifact] - t for artifact, t in titles.items() if wanted[artifact] - t}


def test_negative_rows_give_nothing(spark):
    rows = [("h", "pslist", 0, "f", {"Pid": "1", "Name": "svchost.exe", "Exe": "C:\\Windows\\System32\\svchost.exe"}), ("h", "netstat", 0, "f", {"remote": "1.2.3.4:443", "State": "ESTABLISHED"})]
    rows = spark.createDataFrame(rows, SCHEMA)
    assert processes(canonical(rows.filter("artifact = 'pslist'"), "process")).count() == 0
    assert network(canonical(rows.filter("artifact = 'netstat'"), "network")).count() == 0


def test_routes(spark):
    names = {"browser_history": "generic", "eventlog_taskscheduler": "event", "zeek_dns": "textlog", "pslist": "process", "scheduledtasks": "task", "xyz": "generic"}
    got = spark.createDataFrame([(n,) for n in names], "artifact string").select("artifact", family_of(F.col("artifact")).alias("f")).collect()
    assert {r["artifact"]: r["f"] for r in got} == names


def test_hash_feed_and_own_detector(spark, tmp_path):
    from tracehound.sources.collection import read_hash_feed

    feed = tmp_path / "ioc.txt"
    feed.write_text("# c\n44d88612fea8a8f36de82e1278abb02f,Mimikatz\ntooshort,x\n")
    rows = spark.createDataFrame([("h", "pslist", i, "f", {"Name": "evil.exe", "md5": "44D88612FEA8A8F36DE82E1278ABB02F"}) for i in range(3)] + [("h", "custom_x", 0, "f", {"a": "b"})], SCHEMA)
    known = hash_reputation(rows, read_hash_feed(spark, str(feed)))
    assert [r["title"] for r in known.collect()] == ["Known-bad file hash: Mimikatz"]
    engine = Engine()
    engine.detectors = {}
    engine.register(("custom_",), lambda r: fi.emit(r, "own", "low", "mine", "", 1))
    assert [r["title"] for r in engine.run(rows).collect()] == ["mine"]


def test_artifacts_without_a_telling_name_go_by_their_fields(spark):
    named = {
        "tbl_1": ("process", {"Pid": "1", "Ppid": "0", "Name": "x"}), "tbl_2": ("network", {"Raddr": "1.1.1.1:4444", "Laddr": "2", "State": "ESTABLISHED"}), "tbl_3": ("sysmon", {"EventID": "1", "Image": "x", "ProcessId": "2", "TimeCreated": "t", "Channel": "c"}),
        "tbl_4": ("generic", {"a": "b"}), "tbl_5": ("userassist", {"path": "x", "run_count": "1"}), "pslist": ("process", {"z": "1"}), "tbl_6": ("lnk", {"TargetPath": "t", "CommandLineArguments": ""}),
    }
    rows = [("h", artifact, i, "f", row if i else {}) for artifact, (_, row) in named.items() for i in range(3)]
    # Fields of one artifact may stand in different rows; another host's artifact of that name is another one.
    rows += [("h", "tbl_7", 0, "f", {"QueryName": "a.b"}), ("h", "tbl_7", 1, "f", {"qtype_name": "A"}), ("i", "tbl_7", 0, "f", {"QueryName": "a.b"}), (None, "tbl_5", 0, "f", {"path": "x"})]
    got = {(r["host"], r["artifact"]): r["family"] for r in routed(spark.createDataFrame(rows, SCHEMA)).select("host", "artifact", "family").distinct().collect()}
    assert got == {("h", a): f for a, (f, _) in named.items()} | {("h", "tbl_7"): "dns", ("i", "tbl_7"): "generic", (None, "tbl_5"): "generic"}
    assert routed(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)


def test_an_engine_without_caps_gives_all(spark):
    rows = [("h", "netstat", i, "f", {"remote": f"1.2.3.{i % 14}:443", "State": "ESTABLISHED"}) for i in range(14 * 5)] + [("h", "mft_metadata", i, "f", {"FullPath": f"C:\\Temp\\a{i}.pdf.exe"}) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    count = lambda e: {r["title"].split(" to ")[0]: r["count"] for r in e.run(df).groupBy(F.substring_index("title", " to ", 1).alias("title")).count().collect()}
    cut, whole = count(Engine()), count(Engine(uncut=True))
    assert cut["Potential beaconing"] == 10 and cut["Double extension file (masquerading)"] == 50 and cut["120 executables in suspicious locations"] == 1
    assert whole["Potential beaconing"] == 14 and whole["Double extension file (masquerading)"] == 120 and whole["Executable in suspicious location"] == 120 and len(whole) == 3


def test_a_large_connection_log_stays_dealt_and_each_line_is_parted_once(spark):
    head = ("h", "zeek_conn", -1, "f", {"raw": "#fields\tid.resp_p\tproto\torig_bytes"})
    rows = spark.createDataFrame([head, *[("h", "zeek_conn", i, "f", {"raw": f"{4444 if i % 10 == 0 else 443}\ttcp\t5"}) for i in range(200)]], SCHEMA).repartition(4)
    found = text_logs(rows)
    plan = found._jdf.queryExecution()
    assert "SortMergeJoin" not in plan.executedPlan().toString() and plan.optimizedPlan().toString().count("map_from_arrays") == 1
    assert sorted(r["row_index"] for r in found.collect()) == list(range(0, 200, 10))
    assert text_logs(rows.limit(0)).count() == 0
