"""Row and group detectors by artifact family: canonical rows in, findings out."""

from __future__ import annotations

from collections.abc import Callable

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.functions import scalars as S
from tracehound.functions.signatures import all_matches, at_least, first_match, path_matches
from tracehound.functions.tables import (
    AUTORUN_KEYS, BROWSE_PATHS, EXECUTION_PATHS, HASH_FIELDS, KNOWN_GOOD_SERVICE_NAMES, KNOWN_GOOD_SERVICE_PATHS, LOLBINS, LSASS_READERS, MALWARE_FAMILIES,
    SPECIFIC_CONTENT_RULES, SYSMON_PARENT_CHILDREN, SYSTEM_PROCESS_PATHS, VENDOR_PATHS, WATCHED_PORTS,
)
from tracehound.sources.canonical import ROUTES, canonical, normalised, routed, row_text
from tracehound.sources.staging import staged

from .findings import branch, emit, union
from .lineage import with_parent
from .ordered import failures_then_success, first_of_each, off_hours

Detector = Callable[[DataFrame], DataFrame]
c, lit = F.col, F.lit

#: Fixed values of the detectors.
PARENT_CHILDREN = {
    "winword.exe": ("powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe"), "excel.exe": ("powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe"),
    "outlook.exe": ("powershell.exe", "cmd.exe", "wscript.exe", "mshta.exe"), "powerpnt.exe": ("powershell.exe", "cmd.exe", "wscript.exe"), "w3wp.exe": ("cmd.exe", "powershell.exe", "net.exe", "whoami.exe"),
    "sqlservr.exe": ("cmd.exe", "powershell.exe"), "services.exe": ("cmd.exe", "powershell.exe"),
}
BAD_PIPES = (
    (r"\\?msagent_", "Cobalt Strike default pipe", "high"), (r"\\?MSSE-", "Cobalt Strike named pipe", "high"), (r"\\?postex_", "Cobalt Strike post-exploitation pipe", "high"), (r"\\?status_", "Cobalt Strike pipe pattern", "high"),
    (r"\\?psexesvc", "PsExec service pipe", "high"), (r"\\?paexec", "PAExec pipe", "high"), (r"\\?remcom_", "RemCom lateral tool pipe", "high"), (r"\\?csexecsvc", "CSExec pipe", "high"), (r"\\?\d{4,}", "Metasploit-style numeric pipe", "high"),
)
SYSMON_AUTORUNS = ("\\currentversion\\run", "\\currentversion\\runonce", "\\winlogon\\shell", "\\winlogon\\userinit", "\\image file execution options", "\\appinit_dlls", "\\currentversion\\policies\\explorer\\run", "\\services\\", "\\currentcontrolset\\services")
PAYLOAD = r"-enc\b|frombase64|downloadstring|\biex\b|\\temp\\|\\appdata\\|powershell.*-w\s+hidden"
SCRIPT_ENDINGS = r"\.(exe|dll|ps1|vbs|js|bat|cmd|scr|hta|jar|lnk)$"
PROGRAM_ENDINGS = r"\.(exe|dll|scr|bat|cmd|ps1|vbs|js|jse|wsf|hta|jar|msi|com|pif|cpl)$"
FILE_MASKS = r"\.(pdf|doc|docx|xls|xlsx|jpg|png|txt|zip)\.(exe|scr|bat|cmd|ps1|vbs|com|pif)$"
DATA_PLACES = r"\\temp\\|\\appdata\\|\\programdata\\|\\users\\public\\|\\downloads\\"


def _at_most_one(match: Column) -> Column:
    return F.when(match.isNotNull(), F.array(match))


def _first(rows: DataFrame, match: Column) -> DataFrame:
    return rows.withColumn("m", match).filter("m is not null")


def _place(path: Column, name: Column) -> Column:
    """The first suspicious place of a path that is of medium severity at least."""
    return F.try_element_at(F.filter(path_matches(path, name), lambda m: at_least(m)), lit(1))


def _one_of(path: Column, parts) -> Column:
    return S.any_of([F.contains(F.lower(path), lit(p.lower())) for p in parts])


def _score(severity: Column, high: int, low: int) -> Column:
    return F.when(severity.isin("critical", "high"), high).otherwise(low)


def _image(name: str) -> Column:
    return F.lower(S.base_name(c(name)))


def processes(p: DataFrame) -> DataFrame:
    p = with_parent(p, ["host"])
    text, sev = F.concat_ws(" ", "path", "cmdline"), c("m.severity")
    child = S.base_name(c("name"))
    pairs = S.any_of([(c("parent_name") == parent) & child.isin(*children) for parent, children in PARENT_CHILDREN.items()])
    disguised = S.any_of([(c("name") == n) & (c("path") != "") & ~S.matches(c("path"), pattern) & F.contains(c("path"), lit("\\")) for n, pattern in SYSTEM_PROCESS_PATHS.items()])
    ev = {k: c(k) for k in ("pid", "ppid", "name", "path", "cmdline")}
    return union(
        branch(p, "process_anomaly", "high", F.concat(lit("Suspicious parent-child: "), c("parent_name"), lit(" > "), child), F.concat_ws(" ", c("parent_name"), lit("started"), child), 80, "T1566.001", ev, pairs),
        branch(p, "process_anomaly", sev, F.concat(lit("Suspicious process command: "), c("m.label")), c("cmdline"), _score(sev, 80, 50), "T1059", ev, matches=all_matches(text)),
        branch(p, "process_anomaly", sev, F.concat(lit("Process from suspicious location: "), c("m.label")), c("path"), 60, "T1036", ev, matches=path_matches(c("path"), child)),
        branch(p, "process_anomaly", "critical", F.concat(lit("Process masquerading: "), c("name")), c("path"), 90, "T1036.005", ev, disguised),
    )


def lolbin_uses(p: DataFrame) -> DataFrame:
    return p.agg(F.count_if(S.base_name(c("name")).isin(*LOLBINS)).alias("lolbin_uses"))


def network(n: DataFrame, most: int | None = 10) -> DataFrame:
    use = F.element_at(F.create_map(*[lit(x) for kv in WATCHED_PORTS.items() for x in kv]), c("remote_port"))
    ev = {k: c(k) for k in ("local", "remote", "state", "pid", "process")}
    held = n.filter(F.contains(F.upper("state"), lit("ESTABLISHED")) & (c("remote_ip") != "") & ~c("remote_ip").rlike(r"^(127\.|0\.0|::|\[::)"))
    counts = held.groupBy("host", "artifact", "remote_ip").agg(F.count("*").alias("n"))
    top = first_of_each(counts, ["host", "artifact"], [F.desc("n"), "remote_ip"], most).filter("n >= 5")
    return union(
        branch(n, "network_anomaly", "high", F.concat(lit("Connection to suspicious port "), c("remote_port").cast("string")), F.concat_ws(" ", "process", "remote", use), 70, "T1571", ev, c("remote_port").isin(*WATCHED_PORTS)),
        branch(top, "network_anomaly", "medium", F.concat(lit("Potential beaconing to "), c("remote_ip")), F.concat(c("n").cast("string"), lit(" connections")), 55, "T1071", {"remote": c("remote_ip"), "connection_count": c("n")}),
    )


def dns(d: DataFrame, most: int | None = 10) -> DataFrame:
    d = d.filter("domain <> ''").withColumns({"label": F.substring_index(F.lower("domain"), ".", 1), "registered": S.registered_domain(c("domain"))})
    open_ = d.filter(~S.exempt_domain(c("domain")))

    def frequent(rows: DataFrame, least: int, title: str, mitre: str, score: int) -> DataFrame:
        counts = rows.groupBy("host", "artifact", "registered").agg(F.count("*").alias("n"))
        top = first_of_each(counts, ["host", "artifact"], [F.desc("n"), "registered"], most).filter(c("n") >= least)
        return emit(top, "network_anomaly", "medium", F.concat(lit(title), c("registered")), F.concat(c("n").cast("string"), lit(" queries")), score, mitre, {"domain": c("registered"), "count": c("n")})

    missing = S.matches(c("rcode"), "nxdomain") | (c("rcode") == "3")
    return union(
        branch(open_, "network_anomaly", "low", F.concat(lit("Generated-looking domain: "), c("domain")), c("label"), 40, "T1568.002", {"domain": c("domain"), "entropy": F.round(S.entropy(c("label")), 2), "max_consonant_run": S.consonant_run(c("label"))}, S.looks_generated(c("label"))),
        branch(open_, "network_anomaly", "medium", F.concat(lit("Very long DNS label: "), c("registered")), c("domain"), 50, "T1071.004", {"domain": c("domain")}, F.char_length("label") > 50),
        frequent(open_.filter(missing), 10, "NXDOMAIN burst: ", "T1568.002", 55),
        frequent(open_.filter(F.upper("qtype").isin("TXT", "16")), 20, "High volume of TXT queries: ", "T1071.004", 55),
    )


def services(s: DataFrame) -> DataFrame:
    path = F.lower("path")
    good = F.lower("name").isin(*KNOWN_GOOD_SERVICE_NAMES) | (_one_of(path, KNOWN_GOOD_SERVICE_PATHS) & ~S.matches(path, r"-enc\b|frombase64|downloadstring|iex\s*\("))
    s = s.filter((c("path") != "") & ~good)
    binary = F.substring_index(S.base_name(c("path")), " ", 1)
    ev, sev = {k: c(k) for k in ("name", "path", "account", "start_mode")}, c("m.severity")
    placed = F.filter(F.slice(path_matches(c("path"), binary), 1, 1), lambda m: at_least(m))
    before = F.substring_index(path, ".exe", 1)
    return union(
        branch(s, "persistence", sev, "Service binary in suspicious location", c("path"), F.when(sev == "critical", 90).when(sev == "high", 75).otherwise(50), "T1543.003", ev, matches=placed),
        branch(s, "persistence", F.when(sev.isin("critical", "high"), sev).otherwise("medium"), F.concat(lit("Service with suspicious command: "), c("m.label")), c("path"), 70, "T1543.003", ev, matches=_at_most_one(first_match(c("path"), least=4))),
        branch(s, "persistence", "medium", "Unquoted service path", c("path"), 40, "T1574.009", ev, ~c("path").startswith('"') & F.contains(path, lit(".exe")) & F.contains(before, lit(" "))),
    )


def tasks(t: DataFrame) -> DataFrame:
    t = t.withColumn("full", F.concat_ws(" ", "command", "args"))
    ev = {k: c(k) for k in ("name", "command", "args")}
    return union(
        branch(t, "persistence", c("m.severity"), F.concat(lit("Scheduled task with suspicious command: "), c("m.label")), c("full"), 80, "T1053.005", ev, matches=all_matches(c("full"))),
        branch(t, "persistence", "medium", "Scheduled task references suspicious path", c("full"), 50, "T1053.005", ev, matches=path_matches(c("full"), F.substring_index(S.base_name(c("command")), " ", 1))),
    )


#: Event ids of a plain finding: category, severity, title, score, technique.
PLAIN_EVENTS = {
    (4720,): ("persistence", "high", "New user account created", 70, "T1136.001"), (4728, 4732, 4756): ("privilege_escalation", "high", "Account added to privileged group", 70, "T1098"),
    (4698, 4702): ("persistence", "medium", "Scheduled task created/modified", 55, "T1053.005"),
}
DEFENDER_EVENTS = {
    (5001,): ("defense_evasion", "critical", "Windows Defender real-time protection disabled", 90, "T1562.001"), (5010,): ("defense_evasion", "high", "Windows Defender spyware/PUA scanning disabled", 88, "T1562.001"),
    (5012,): ("defense_evasion", "high", "Windows Defender virus scanning disabled", 88, "T1562.001"), (5004, 5008): ("defense_evasion", "medium", "Windows Defender engine error or failure", 50, "T1562.001"),
    (5007,): ("defense_evasion", "medium", "Windows Defender configuration changed", 45, "T1562.001"), (3002,): ("defense_evasion", "medium", "Windows Defender real-time protection error", 50, "T1562.001"),
}


def events(e: DataFrame) -> DataFrame:
    channel, artifact, eid = F.lower("channel"), F.lower("artifact"), c("event_id")
    ev, when = {"event_id": eid, "timestamp": c("time"), "data": c("data")}, F.concat(lit("Event "), eid.cast("string"), lit(" at "), c("time"))
    security = F.contains(channel, lit("security")) | F.contains(artifact, lit("evtx_security")) | artifact.endswith("security") | (channel == "")
    system = F.contains(channel, lit("security")) | F.contains(channel, lit("system")) | F.contains(channel, lit("eventlog")) | F.contains(F.lower("provider"), lit("eventlog")) | artifact.endswith("security") | artifact.endswith("system") | artifact.rlike("evtx_(security|system)")
    defender = F.contains(channel, lit("defender")) | F.contains(artifact, lit("defender")) | F.contains(F.lower("provider"), lit("defender"))
    service = S.matches(c("data"), PAYLOAD)
    plain = [branch(e, *f[:2], f[2], when, f[3], f[4], ev, eid.isin(*ids)) for ids, f in PLAIN_EVENTS.items()]
    plain += [branch(e, *f[:2], f[2], when, f[3], f[4], ev, eid.isin(*ids) & defender) for ids, f in DEFENDER_EVENTS.items()]
    threat = F.regexp_extract("data", r"(?i)([A-Za-z]+:[A-Za-z0-9]+/[A-Za-z0-9_.!-]+)", 1)
    allowed = S.matches(c("data"), r"\bAllow\b")
    failed = e.filter(eid == 4625).withColumn("source", F.coalesce(S.ipv4(c("data")), lit("unknown")))
    brute = failed.groupBy("host", "artifact", "source").agg(F.count("*").alias("n")).filter("n >= 5")
    script = lambda kind, title, score, mitre: branch(e, "execution", c("m.severity"), F.concat(lit(title), c("m.label")), when, score, mitre, ev, eid == kind, _at_most_one(first_match(c("data"))))
    return union(
        branch(e, "defense_evasion", "critical", "Security audit log cleared", when, 95, "T1070.001", ev, (eid == 1102) & security),
        branch(e, "defense_evasion", "high", "Event log cleared", when, 75, "T1070.001", ev, (eid == 104) & system),
        *plain,
        branch(e, "persistence", F.when(service, "high").otherwise("medium"), "New service installed", when, F.when(service, 75).otherwise(50), "T1543.003", ev, eid.isin(4697, 7045)),
        script(4104, "Suspicious PowerShell script block: ", 75, "T1059.001"), script(4688, "Suspicious process creation: ", 70, "T1059"),
        branch(e, "malware", "critical", F.concat(lit("Windows Defender detected: "), F.when(threat != "", threat).otherwise("unknown threat")), when, 95, "T1204", ev, (eid == 1116) & defender),
        branch(e, "malware", F.when(allowed, "critical").otherwise("high"), F.concat(lit("Defender action taken on detected threat"), F.when(allowed, " (allowed)").otherwise("")), when, F.when(allowed, 95).otherwise(80), "T1204", ev, (eid == 1117) & defender),
        branch(brute, "credential_access", "high", F.concat(lit("Possible brute-force from "), c("source")), F.concat(c("n").cast("string"), lit(" failed logons")), 65, "T1110", {"source": c("source"), "attempt_count": c("n")}),
    )


def auth(e: DataFrame) -> DataFrame:
    """Patterns of logons by account, in order of time."""
    e = e.filter(c("event_id").isin(4624, 4625) & c("ts").isNotNull() & (c("account") != ""))
    success = e.filter("event_id = 4624")
    guessed = failures_then_success(e.withColumn("who", F.struct("host", "artifact", "account")), "who", "ts", "row_index", c("event_id") == 4625, c("event_id") == 4624).select("who.*", "ts", "row_index", "failures")
    sources = success.filter("source_ip is not null").groupBy("host", "artifact", "account").agg(F.sort_array(F.collect_set("source_ip")).alias("ips")).filter(F.size("ips") >= 3)
    late = (c("event_id") == 4624) & c("logon_type").isin("2", "10") & off_hours(c("ts"))
    return union(
        branch(guessed, "credential_access", "high", F.concat(lit("Successful logon for '"), c("account"), lit("' after "), c("failures").cast("string"), lit(" failed attempts")), c("ts").cast("string"), 85, "T1110", {"account": c("account"), "failed_attempts": c("failures")}),
        branch(sources, "credential_access", "medium", F.concat(lit("Account '"), c("account"), lit("' logged on from "), F.size("ips").cast("string"), lit(" distinct sources")), F.array_join(F.slice("ips", 1, 5), ", "), 50, "T1078", {"account": c("account")}),
        branch(e, "credential_access", "low", F.concat(lit("Off-hours privileged logon for '"), c("account"), lit("'")), c("ts").cast("string"), 30, "T1078", {"account": c("account"), "hour": F.hour("ts"), "logon_type": c("logon_type")}, late),
    )


def sysmon(s: DataFrame) -> DataFrame:
    eid, image = c("event_id"), _image("Image")
    ev = {"name": image, "path": c("Image"), "cmdline": c("CommandLine"), "pid": c("ProcessId")}
    sev, parent = c("m.severity"), _image("ParentImage")
    created, text = eid == 1, F.concat_ws(" ", "Image", "CommandLine")
    pairs = S.any_of([(parent == p) & image.isin(*children) for p, children in SYSMON_PARENT_CHILDREN.items()])
    net, watched = eid == 3, F.coalesce(c("port").isin(*WATCHED_PORTS), lit(False))
    outside = (c("DestinationIp") != "") & ~c("DestinationIp").rlike(r"^(127\.|::1|0\.0|169\.254|fe80)")
    reader = (eid == 10) & (_image("TargetImage") == "lsass.exe") & ~_image("SourceImage").isin(*LSASS_READERS)
    unknown = F.contains(F.lower("CallTrace"), lit("unknown"))
    dropped = (eid == 11) & S.matches(c("TargetFilename"), SCRIPT_ENDINGS)
    return union(
        branch(s, "process_anomaly", sev, F.concat(lit("Sysmon: suspicious process command ("), c("m.label"), lit(")")), c("CommandLine"), _score(sev, 80, 50), "T1059", ev, created, matches=_at_most_one(first_match(text))),
        branch(s, "process_anomaly", sev, F.concat(lit("Sysmon: process from suspicious location ("), c("m.label"), lit(")")), c("Image"), 60, "T1036", ev, created, matches=_at_most_one(F.try_element_at(path_matches(c("Image"), image), lit(1)))),
        branch(s, "process_anomaly", "high", F.concat(lit("Sysmon: suspicious parent-child ("), parent, lit(" > "), image, lit(")")), c("CommandLine"), 80, "T1566.001", ev, (created) & (pairs)),
        branch(s, "network_anomaly", "high", F.concat(lit("Sysmon: connection to suspicious port "), c("port").cast("string")), c("DestinationIp"), 70, "T1571", ev | {"remote": F.concat_ws(":", "DestinationIp", "DestinationPort")}, (net) & (watched)),
        branch(s, "network_anomaly", "high", F.concat(lit("Sysmon: LOLBin '"), image, lit("' made a network connection")), c("DestinationIp"), 70, "T1105", ev | {"remote": F.concat_ws(":", "DestinationIp", "DestinationPort")}, (net) & (~F.coalesce(watched, lit(False)) & image.isin(*LOLBINS) & outside)),
        branch(s, "defense_evasion", "high", F.concat(lit("Sysmon: remote thread injection ("), _image("SourceImage"), lit(" > "), _image("TargetImage"), lit(")")), c("SourceImage"), 80, "T1055", {"name": _image("SourceImage"), "target": _image("TargetImage")}, eid == 8),
        branch(s, "credential_access", F.when(unknown, "critical").otherwise("high"), F.concat(lit("Sysmon: lsass.exe memory access by '"), _image("SourceImage"), lit("'")), c("GrantedAccess"), F.when(unknown, 90).otherwise(78), "T1003.001", {"name": _image("SourceImage"), "call_trace": c("CallTrace")}, reader),
        branch(s, "execution", "medium", "Sysmon: executable/script dropped in suspicious location", c("TargetFilename"), 45, "T1105", {"path": c("TargetFilename"), "creator": image}, dropped, matches=_at_most_one(_place(c("TargetFilename"), S.base_name(c("TargetFilename"))))),
        branch(s, "lateral_movement", "high", F.concat(lit("Sysmon: suspicious named pipe ("), c("m.label"), lit(")")), c("PipeName"), 72, "T1021.002", {"name": image, "pipe": c("PipeName")}, eid.isin(17, 18), matches=_at_most_one(first_match(c("PipeName"), BAD_PIPES))),
        branch(s, "defense_evasion", "high", F.concat(lit("Sysmon: process tampering detected ("), c("Type"), lit(")")), c("Image"), 82, "T1055.012", ev, eid == 25),
        branch(s, "persistence", "medium", "Sysmon: autorun/persistence registry modification", c("TargetObject"), 55, "T1547.001", {"name": image, "key": c("TargetObject"), "value": c("Details")}, (eid.isin(12, 13)) & (_one_of(c("TargetObject"), SYSMON_AUTORUNS))),
        branch(s, "defense_evasion", "high", F.concat(lit("Sysmon: unsigned driver loaded ("), _image("ImageLoaded"), lit(")")), c("ImageLoaded"), 70, "T1014", {"path": c("ImageLoaded"), "signature": c("Signature")}, (eid == 6) & (F.lower("Signed") == "false")),
    )


def registry(r: DataFrame) -> DataFrame:
    autorun = _one_of(c("key"), AUTORUN_KEYS)
    r = r.withColumn("autorun", autorun)
    ev, sev = {k: c(k) for k in ("key", "name", "value")}, c("m.severity")
    binary = F.substring_index(S.base_name(c("value")), " ", 1)
    placed = _at_most_one(_place(c("value"), binary))
    return union(
        branch(r, "persistence", F.when(sev.isin("critical", "high") & c("autorun"), sev).otherwise("medium"), F.concat(lit("Suspicious registry value: "), c("m.label")), c("value"), F.when(c("autorun"), 70).otherwise(45), "T1547.001", ev, F.char_length("value") >= 6, matches=_at_most_one(first_match(c("value"), least=4))),
        branch(r, "persistence", "medium", "Registry autorun from suspicious path", c("value"), 55, "T1547.001", ev, c("autorun") & (c("value") != ""), placed),
    )


def links(x: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "target", "args")
    return union(branch(x, "execution", c("m.severity"), F.concat(lit("Shortcut with suspicious target: "), c("m.label")), text, 65, "T1204.002", {"target": c("target"), "args": c("args")}, matches=all_matches(text)))


def execution(x: DataFrame) -> DataFrame:
    return union(branch(x, "execution_evidence", c("m.severity"), F.concat(lit("Execution evidence: "), c("m.label")), c("path"), 45, "T1204", {"name": c("name"), "path": c("path")}, matches=path_matches(c("path"), c("name"))))


def _cache(x: DataFrame, kind: str, table, scores: tuple[int, int], mitre: str, mask: tuple[str, int, str] | None, category: str = "execution_evidence") -> DataFrame:
    ev, sev = {"path": c("path")}, c("m.severity")
    x = x.filter("path <> ''")
    out = branch(x, category, sev, F.concat(lit(f"{kind}: "), c("m.label")), c("path"), F.when(sev == "medium", scores[0]).otherwise(scores[1]), mitre, ev, matches=_at_most_one(first_match(c("path"), table)))
    return union(out) if mask is None else union(out, branch(x, category, "high", mask[0], c("path"), mask[1], mask[2], ev, S.double_extension(c("path"))))


def shimcache(x: DataFrame) -> DataFrame:
    return _cache(x, "Shimcache", EXECUTION_PATHS, (55, 70), "T1218", ("Shimcache: double-extension masquerade executed", 80, "T1036.007"))


def userassist(x: DataFrame) -> DataFrame:
    return _cache(x, "UserAssist", EXECUTION_PATHS, (50, 65), "T1204.002", ("UserAssist: double-extension masquerade launched by user", 82, "T1204.002"))


def shellbags(x: DataFrame) -> DataFrame:
    return _cache(x, "Shellbags", BROWSE_PATHS, (30, 30), "T1083", None)


def files(x: DataFrame, most_masked: int | None = 50, most_placed: int | None = 100) -> DataFrame:
    x = x.filter("path <> ''")
    masked = first_of_each(x.filter(S.matches(c("path"), FILE_MASKS)), ["host", "artifact"], ["row_index"], most_masked)
    placed = _first(x.filter(S.matches(c("path"), PROGRAM_ENDINGS)), F.try_element_at(path_matches(c("path"), S.base_name(c("path"))), lit(1)))
    many = placed.groupBy("host", "artifact").agg(F.count("*").alias("n")).filter(lit(False) if most_placed is None else c("n") > most_placed)
    ev = {"path": c("path")}
    return union(
        branch(masked, "defense_evasion", "high", "Double extension file (masquerading)", c("path"), 70, "T1036.007", ev),
        branch(first_of_each(placed, ["host", "artifact"], ["row_index"], most_placed), "suspicious_file", "medium", "Executable in suspicious location", c("path"), 45, "T1036", ev),
        branch(many, "suspicious_file", "high", F.concat(c("n").cast("string"), lit(" executables in suspicious locations")), "", 60, "T1036", {"total_count": c("n")}),
    )


def av_log(a: DataFrame) -> DataFrame:
    kind, ev = c("event_type"), {k: c(k) for k in ("threat_name", "file", "pid", "process", "max_time_file", "sha256")}
    n = F.coalesce(c("files_accessed").try_cast("int"), lit(0))
    path = F.lower("max_time_file")
    share = F.contains(path, lit("\\device\\mup\\")) | c("max_time_file").rlike(r"^\\\\[^\\]+\\[^\\]+")
    local, many = path.rlike(DATA_PLACES), n >= 1000
    reason = F.when(share, "accessed many files of a network share").when(many & ~local, "accessed an unusually high number of files").otherwise("accessed a file in a suspicious location")
    return union(
        branch(a, "malware", "critical", F.concat(lit("MPLog: Defender detected "), c("threat_name")), c("file"), 90, "T1204", ev, kind == "detection"),
        branch(a, "malware", "critical", F.concat(lit("MPLog: memory scan detected "), c("threat_name")), c("pid"), 92, "T1055", ev, kind == "ems_detection"),
        branch(a, "execution_evidence", "low", F.concat(lit("MPLog: cloud lookup of "), S.base_name(c("file"))), c("sha256"), 35, "T1204", ev, kind == "sdn"),
        branch(a, "execution", F.when(share | many, "high").otherwise("low"), F.concat_ws(" ", lit("MPLog:"), "process", reason), c("max_time_file"), F.when(share | many, 70).otherwise(40), F.when(share, "T1567").otherwise("T1204"), ev, (kind == "estimated_impact") & (local | share | many)),
    )


def content(x: DataFrame) -> DataFrame:
    """Matches of content rules: a known family's severity wins, vendor folders make a note of all but specific rules."""
    vendor = _one_of(F.translate("filename", "/", "\\"), VENDOR_PATHS) & ~c("rule").isin(*SPECIFIC_CONTENT_RULES)
    family = F.coalesce(*[F.when(F.contains(F.lower("rule"), lit(k.lower())), F.struct(lit(v[0]).alias("severity"), lit(v[1]).alias("mitre"))) for k, v in MALWARE_FAMILIES.items()])
    x = x.withColumn("family", family).withColumn("level", F.coalesce("family.severity", F.nullif("severity", lit("")), lit("medium")))
    changed = F.coalesce(c("family.severity") != c("severity"), lit(False)) & (c("mitre") == "")
    score = F.element_at(F.create_map(*[lit(v) for kv in {"critical": 92, "high": 78, "medium": 55, "low": 30, "info": 15}.items() for v in kv]), F.lower("level"))
    ev = {"rule": c("rule"), "path": c("filename"), "matched_strings": c("matched")}
    return union(
        branch(x, "yara_match", c("level"), F.concat(lit("Content rule match: "), c("rule")), c("description"), F.coalesce(score, lit(55)), F.when(changed, c("family.mitre")).otherwise(c("mitre")), ev, ~vendor),
        branch(x, "yara_match", F.when(c("level").isin("critical", "high"), "low").otherwise("info"), F.concat(lit("Content rule match in vendor folder: "), c("rule")), c("description"), 15, c("mitre"), ev, vendor),
    )


def hash_reputation(rows: DataFrame, ioc: DataFrame) -> DataFrame:
    """One finding for each known hash of an artifact, from its first row; ioc(hash, note), joined by hash."""
    fields = F.array(*[F.struct(lit(f).alias("field"), F.lower(F.trim(c("row")[f])).alias("hash")) for f in HASH_FIELDS])
    held = rows.select("host", "artifact", "row_index", "source_file", F.explode(fields).alias("h")).select("*", "h.*").drop("h").filter(F.char_length("hash").isin(32, 40, 64))
    hits = held.join(ioc.select(F.lower("hash").alias("hash"), "note"), "hash")
    first = hits.groupBy("host", "artifact", "hash").agg(F.min("row_index").alias("row_index"), F.min_by("source_file", "row_index").alias("source_file"), F.min_by("note", "row_index").alias("note"))
    return emit(first, "hash_reputation", "critical", F.concat(lit("Known-bad file hash: "), F.when(F.coalesce("note", lit("")) != "", c("note")).otherwise(c("hash"))), c("hash"), 95, "T1204.002", {"hash": c("hash"), "note": c("note")})


def generic(rows: DataFrame, most: int | None = 200) -> DataFrame:
    hit = _first(rows.withColumn("text", row_text(c("row"))), first_match(c("text"), among=("critical", "high")))
    return emit(first_of_each(hit, ["host", "artifact"], ["row_index"], most), "suspicious_content", c("m.severity"), F.concat(lit("Suspicious content: "), c("m.label")), F.substring("text", 1, 200), 45, "T1059")


DETECTORS: dict[str, list[Detector]] = {
    "process": [processes], "network": [network], "dns": [dns], "service": [services], "task": [tasks], "event": [events, auth], "sysmon": [sysmon], "registry": [registry], "lnk": [links], "execution": [execution],
    "shimcache": [shimcache], "userassist": [userassist], "shellbags": [shellbags], "file": [files], "avlog": [av_log], "content": [content],
}
#: Families of a user's own: route parts, family columns and detectors are added by register().
HASH_FAMILIES = ("process", "file", "content", "execution")


#: Detectors that give a host's first findings only, and the same without a limit.
UNCUT: dict[Detector, Detector] = {network: partial(network, most=None), dns: partial(dns, most=None), files: partial(files, most_masked=None, most_placed=None), generic: partial(generic, most=None)}


class Engine:
    """Routes the rows of a collection to detectors; detectors, extra passes and families can be added. With uncut, detectors
    that give the first findings of a host give all of them."""

    def __init__(self, uncut: bool = False):
        self.routes = list(ROUTES)
        self.own = UNCUT if uncut else {}
        self.detectors = {k: [self.own.get(d, d) for d in v] for k, v in DETECTORS.items()}
        self.raw: list[tuple[tuple[str, ...], Detector]] = []

    def register(self, artifact_parts: tuple[str, ...], detector: Detector, additional: bool = False) -> None:
        """A detector of raw rows for artifacts with one of these parts in their names: instead of the built-in ones,
        or beside them."""
        if not additional:
            self.routes.insert(0, (tuple(artifact_parts), f"own:{len(self.raw)}"))
        self.raw.append((tuple(artifact_parts), detector))

    def run(self, rows: DataFrame, ioc: DataFrame | None = None) -> DataFrame:
        """All findings of rows(host, artifact, row_index, source_file, row), each artifact's by the family that its name tells, or
        the fields of its rows.

        The routed rows are written once, a folder for each family, so that a family's detectors read its rows only;
        all its row detectors share one pass, and only grouped and ordered ones read the rows again.
        """
        from .textlogs import text_logs

        own = S.any_of([F.contains(F.lower("artifact"), lit(p)) for parts, family in self.routes if family.startswith("own:") for p in parts]) if self.raw else lit(False)
        placed = routed(normalised(rows)).withColumn("family", F.when(own, "own").otherwise(c("family")))
        placed = staged(placed, "routed", by="family")
        parts = [detect(canonical(placed.filter(c("family") == family), family)) for family, found in self.detectors.items() for detect in found]
        parts += [text_logs(placed.filter(c("family") == "textlog")), self.own.get(generic, generic)(placed.filter(c("family") == "generic"))]
        parts += [detect(placed.filter(S.any_of([F.contains(F.lower("artifact"), lit(p)) for p in names]))) for names, detect in self.raw]
        if ioc is not None:
            parts.append(hash_reputation(placed.filter(c("family").isin(*HASH_FAMILIES)), ioc))
        return union(*parts)
