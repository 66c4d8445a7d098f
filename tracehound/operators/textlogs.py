"""Detectors of text logs: sensor alerts, web access, connection logs, system logs and exported tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions import scalars as S
from tracehound.functions.scalars import alias
from tracehound.sources.staging import near, staged

from .findings import Branch, branch, emit, union

c, lit = F.col, F.lit

#: Patterns and tables of the log formats.
ALERT_PREFIXES = {"ET EXPLOIT": ("high", "T1190"), "ET MALWARE": ("high", "T1059"), "ET SCAN": ("medium", "T1046"), "ET POLICY": ("medium", "T1071"), "ET TROJAN": ("high", "T1105"), "ET INFO": ("low", "T1071")}
ACCESS_LINE = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+\S+"\s+(\d{3})\s+(\S+)'
SUSPICIOUS_URI = r"(\.\./|%2e%2e|%00|/etc/passwd|/etc/shadow|cmd\.exe|/bin/sh|phpinfo|eval\(|base64_decode|union.*select|<script|\.php\?.*=http|/wp-admin|/xmlrpc\.php|/shell\.|/webshell)"
SYSTEM_LINES = (
    (r"Failed password for (?:invalid user )?(\S+) from (\S+)", "high", "T1110.001", "SSH brute-force / failed password"),
    (r"Accepted (?:password|publickey) for (\S+) from (\S+)", "low", "T1078", "SSH successful login"),
    (r"Invalid user (\S+) from (\S+)", "medium", "T1110.003", "SSH invalid user enumeration"),
    (r"sudo:\s+(\S+) : .*COMMAND=(.*)", "medium", "T1548.003", "Sudo command execution"),
    (r"useradd|groupadd|usermod|passwd (?!:)", "high", "T1136.001", "User/group modification"),
    (r"crontab|at\.allow|/etc/cron", "medium", "T1053.003", "Cron persistence"),
    (r"segfault|kernel BUG|Oops|panic", "medium", "T1499", "Kernel error / crash"),
    (r"iptables|ufw|firewalld", "low", "T1562.004", "Firewall rule change"),
    (r"insmod|modprobe|rmmod", "high", "T1547.006", "Kernel module load/unload"),
    (r"(chmod|chown)\s+[0-9]*7[0-9]*\s", "medium", "T1222", "Permissive file permission change"),
)
EXPORT_WORDS = r"fail|error|deny|block|attack|malware|exploit|trojan|shell|inject|privilege|escalat|lateral|mimikatz|credential|dump|ransomware|suspicious|alert|critical|high.sever"
LARGE_BYTES, LONG_SECONDS = 50_000_000, 3600
SCORES = {"critical": 70, "high": 60, "medium": 45, "low": 25}


def _score(severity: Column) -> Column:
    return F.element_at(F.create_map(*[lit(x) for kv in SCORES.items() for x in kv]), severity)


def log_format(rows: DataFrame) -> DataFrame:
    """(artifact, format): by the artifact's name, else by what its lines look like."""
    key, line = F.lower("artifact"), alias(c("row"), "raw", "line")
    has = lambda *parts: S.any_of([F.contains(key, lit(p)) for p in parts])
    zeek = F.when(has("dns"), "zeek_dns").when(has("http"), "zeek_http").otherwise("zeek_conn")
    named = F.when(has("suricata", "eve"), "suricata").when(has("zeek", "bro"), zeek).when(has("apache", "nginx", "iis", "access"), "apache").when(has("auth", "secure", "syslog"), "syslog").when(has("csv", "siem", "splunk", "elastic"), "csv")
    seen = rows.groupBy("artifact").agg(
        F.bool_or(F.contains(line, lit('"event_type":"alert"')) | F.contains(line, lit('"alert":{'))).alias("alert"), F.bool_or(line.startswith("#fields\tts\t") & F.contains(line, lit("query"))).alias("dns"),
        F.bool_or(line.startswith("#fields\tts\t") & F.contains(line, lit("uri"))).alias("http"), F.bool_or(line.startswith("#fields\tts\t")).alias("conn"), F.bool_or(line.rlike(ACCESS_LINE)).alias("access"),
        F.bool_or(line.rlike("Failed password|Accepted password|Invalid user|sudo:")).alias("system"), F.bool_and(line == "").alias("fields"),
    )
    looks = F.when(c("alert"), "suricata").when(c("dns"), "zeek_dns").when(c("http"), "zeek_http").when(c("conn"), "zeek_conn").when(c("access"), "apache").when(c("system"), "syslog").when(c("fields"), "csv").otherwise("syslog")
    return seen.select("artifact", F.coalesce(named, looks).alias("format"))


def sensor_alerts(rows: DataFrame) -> DataFrame:
    schema = "event_type string, timestamp string, src_ip string, dest_ip string, dest_port int, proto string, alert struct<signature:string, category:string, severity:int>"
    own = rows.withColumn("e", F.from_json(alias(c("row"), "raw", "line"), schema)).filter("e.event_type = 'alert'")
    signature = c("e.alert.signature")
    pick = lambda i, default: F.coalesce(*[F.when(signature.startswith(p), v[i]) for p, v in ALERT_PREFIXES.items()], lit(default))
    return emit(own, "network_anomaly", pick(0, "medium"), F.concat(lit("Suricata: "), signature), F.concat_ws(" ", "e.src_ip", lit(">"), "e.dest_ip", "e.alert.category"), _score(pick(0, "medium")), pick(1, "T1071"), {"source_ip": c("e.src_ip"), "dest_ip": c("e.dest_ip"), "dest_port": c("e.dest_port"), "signature": signature})


def access_log(rows: DataFrame) -> DataFrame:
    line = alias(c("row"), "raw", "line")
    own = rows.filter(line.rlike(ACCESS_LINE)).withColumns({n: F.regexp_extract(line, ACCESS_LINE, i) for i, n in enumerate(("ip", "time", "method", "path", "status", "size"), 1)})
    odd = S.matches(c("path"), SUSPICIOUS_URI)
    severity = F.when(odd | (c("status") == "500"), "high").otherwise("medium")
    return emit(own, "network_anomaly", severity, F.concat(lit("HTTP "), c("status"), lit(" "), c("method"), lit(" "), F.substring("path", 1, 80)), F.concat_ws(" ", "method", "path", lit("from"), "ip"), _score(severity), "T1190", {"source_ip": c("ip"), "method": c("method"), "path": c("path"), "status": c("status")}, c("status").rlike("^[45]") | odd)


def zeek_records(rows: DataFrame) -> DataFrame:
    """Lines of tab-parted logs as maps, by the #fields line of their artifact and file."""
    line = alias(c("row"), "raw", "line")
    lines = rows.withColumn("line", line)
    heads = lines.filter(c("line").startswith("#fields\t")).groupBy("artifact", "source_file").agg(F.min_by("line", "row_index").alias("head"))
    # One row a file, so that a file of any size is joined where its lines are.
    heads = staged(heads, "zeek-heads")
    heads = near(heads, heads.count())
    names = F.split(F.regexp_replace("head", "^#fields\t", ""), "\t")
    body = lines.filter(~c("line").startswith("#") & (c("line") != ""))
    joined = body.join(heads, (body["artifact"] == heads["artifact"]) & body["source_file"].eqNullSafe(heads["source_file"])).drop(heads["artifact"]).drop(heads["source_file"])
    values = F.split("line", "\t")
    n = F.least(F.size(names), F.size(values))
    return joined.withColumn("rec", F.map_from_arrays(F.slice(names, 1, n), F.slice(values, 1, n)))


def zeek(rows: DataFrame, kind: str) -> Branch:
    """Left to union(), where a line is parted once for all that its fields are asked for."""
    own = zeek_records(rows)
    get = lambda n: F.coalesce(c("rec")[n], lit(""))
    source, target, port_ = get("id.orig_h"), get("id.resp_h"), get("id.resp_p")
    if kind == "conn":
        out, back, seconds = (F.coalesce(get(n).try_cast("double"), lit(0.0)) for n in ("orig_bytes", "resp_bytes", "duration"))
        odd = (out > LARGE_BYTES) | (back > LARGE_BYTES) | ((get("proto") == "tcp") & port_.isin("4444", "1337", "31337", "9001", "8888")) | ((seconds > LONG_SECONDS) & (out > 1_000_000))
        severity = F.when(port_.isin("4444", "1337", "31337"), "high").otherwise("medium")
        return branch(own, "network_anomaly", severity, F.concat(lit("Zeek: suspicious connection "), source, lit(">"), target, lit(":"), port_), F.concat_ws(" ", get("proto"), get("conn_state")), _score(severity), F.when(out > LARGE_BYTES, "T1041").otherwise("T1071"), {"source_ip": source, "remote": target, "port": port_, "orig_bytes": get("orig_bytes")}, odd)
    if kind == "dns":
        q = get("query")
        long = (F.char_length(q) > 50) | (F.char_length(q) - F.char_length(F.replace(q, lit("."), lit(""))) > 5)
        return branch(own, "network_anomaly", "medium", F.concat(lit("Zeek DNS: suspicious query "), F.substring(q, 1, 60)), F.concat_ws(" ", get("qtype_name"), source), 45, F.when(long, "T1568").otherwise("T1071.004"), {"query": q, "qtype": get("qtype_name"), "src": source}, long | get("qtype_name").isin("TXT", "NULL", "ANY"))
    odd = S.matches(get("uri"), SUSPICIOUS_URI) | (get("method").isin("PUT", "DELETE") & get("host").isin("", "-"))
    return branch(own, "network_anomaly", "high", F.concat(lit("Zeek HTTP: suspicious "), get("method"), lit(" "), F.substring(get("uri"), 1, 60)), F.concat_ws(" ", source, get("host")), 60, "T1190", {"uri": get("uri"), "method": get("method"), "host": get("host"), "src": source}, odd)


def system_log(rows: DataFrame) -> DataFrame:
    line = alias(c("row"), "raw", "line")
    group = lambda p, i: F.regexp_extract(line, f"(?i){p}", i) if p.replace("(?:", "").replace("(?!", "").count("(") >= i else lit("")
    entry = [F.when(S.matches(line, p), F.struct(lit(sev).alias("severity"), lit(mitre).alias("mitre"), lit(label).alias("label"), group(p, 1).alias("user"), group(p, 2).alias("source"))) for p, sev, mitre, label in SYSTEM_LINES]
    own = rows.withColumn("m", F.coalesce(*entry)).filter("m is not null")
    return emit(own, F.when(F.contains(F.lower("m.label"), lit("sudo")), "process_anomaly").otherwise("credential_access"), c("m.severity"), c("m.label"), F.substring(line, 1, 200), _score(c("m.severity")), c("m.mitre"), {"user": c("m.user"), "source": c("m.source"), "raw": F.substring(line, 1, 300)})


def exported_rows(rows: DataFrame) -> DataFrame:
    text, row = F.concat_ws(" ", F.map_values("row")), c("row")
    message = F.coalesce(F.nullif(alias(row, "message", "Message", "description", "Description", "EventData"), lit("")), F.substring(text, 1, 200))
    said = alias(row, "severity", "Severity", "priority")
    severity = S.severity_of(F.when(said != "", said).otherwise(message))
    return emit(rows, "sigma_detection", severity, F.substring(message, 1, 80), F.substring(message, 1, 300), _score(severity), "", {"source_ip": alias(row, "src_ip", "SourceIP", "src")}, S.matches(text, EXPORT_WORDS))


def text_logs(rows: DataFrame) -> DataFrame:
    """Findings of all text logs of a collection, each read in its own format. Rows are routed once, into a folder a format; the
    formats are a row an artifact, so that an artifact of any size stays dealt to the tasks that read it."""
    formats = staged(log_format(rows), "textlog-formats")
    kinds = [r[0] for r in formats.select("format").distinct().collect()]
    placed = staged(rows.join(near(formats, formats.count()), "artifact"), "textlog-rows", by="format")
    readers = {
        "suricata": sensor_alerts, "apache": access_log, "zeek_conn": lambda own: zeek(own, "conn"), "zeek_dns": lambda own: zeek(own, "dns"), "zeek_http": lambda own: zeek(own, "http"),
        "syslog": system_log, "csv": exported_rows,
    }
    # A collection without rows has the findings' columns still.
    held = [f for f in readers if f in kinds] or ["syslog"]
    return union(*[readers[f](placed.filter(c("format") == f).drop("format")) for f in held])
