"""Raw rows (host, artifact, row_index, source_file, row map<string,string>) to typed tables by artifact family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.scalars import alias, all_of, any_of, parse_time

PLACE = ("host", "artifact", "row_index", "source_file")

#: Canonical column -> names it is known by, first that is there and not empty.
FAMILIES: dict[str, dict[str, tuple[str, ...]]] = {
    "process": {
        "pid": ("Pid", "pid", "ProcessId", "PID"), "ppid": ("Ppid", "ppid", "ParentProcessId", "PPID"), "name": ("Name", "name", "ProcessName", "Exe", "command"),
        "path": ("Exe", "Path", "path", "CommandLine", "ExecutablePath"), "cmdline": ("CommandLine", "cmdline", "Cmd", "command"), "user": ("User", "Username", "user", "Owner", "SID"), "hash": ("Hash", "sha256", "SHA256", "sha1", "MD5"),
    },
    "network": {
        "remote": ("Raddr", "RemoteAddress", "remote", "remote_address", "ForeignAddress"), "remote_port": ("remote_port", "RemotePort"), "local": ("Laddr", "LocalAddress", "local", "local_address"),
        "state": ("Status", "State", "state"), "pid": ("Pid", "pid", "OwningProcess"), "process": ("Name", "Process", "process_name"),
    },
    "dns": {"domain": ("domain", "Domain", "QueryName", "query", "hostname", "name"), "rcode": ("rcode", "ResponseCode", "status"), "qtype": ("type", "QueryType", "qtype_name"), "pid": ("Pid", "pid", "ProcessId")},
    "service": {"name": ("Name", "name", "ServiceName", "DisplayName"), "path": ("PathName", "ImagePath", "image_path", "Exe", "path", "CommandLine"), "account": ("StartName", "account", "ServiceAccount"), "start_mode": ("StartMode", "start_type", "StartType"), "pid": ("Pid", "pid", "ProcessId")},
    "task": {"name": ("Name", "name", "TaskName"), "command": ("Command", "command", "Action", "action", "Exe", "Arguments"), "args": ("Arguments", "args", "Args"), "pid": ("Pid", "pid", "ProcessId")},
    "event": {
        "event_id": ("EventID", "event_id", "Id", "ID", "id"), "time": ("TimeCreated", "timestamp", "Timestamp", "time"), "channel": ("Channel", "channel", "LogName"), "provider": ("provider", "Provider", "SourceName"),
        "account": ("TargetUserName", "account", "User", "Username"), "logon_type": ("LogonType",),
    },
    "sysmon": {c: (c,) for c in ("Image", "CommandLine", "ParentImage", "ParentCommandLine", "ProcessId", "Hashes", "DestinationIp", "DestinationPort", "SourceImage", "TargetImage", "GrantedAccess", "CallTrace", "TargetFilename", "PipeName", "Type", "TargetObject", "Details", "ImageLoaded", "Signed", "Signature")} | {"event_id": ("EventID", "event_id", "Id", "ID", "id")},
    "registry": {"key": ("key", "Key", "FullPath", "path", "location"), "value": ("value", "Value", "Data"), "name": ("name", "Name", "ValueName"), "pid": ("Pid", "pid", "ProcessId")},
    "lnk": {"target": ("target", "Target", "TargetPath", "RelativePath", "LocalPath"), "args": ("args", "Arguments", "CommandLineArguments")},
    "execution": {"name": ("Name", "name", "Executable", "executable", "FileName"), "path": ("Path", "path", "FullPath")},
    "shimcache": {"path": ("path",), "last_modified": ("last_modified",)},
    "userassist": {"path": ("path",), "run_count": ("run_count",), "last_executed": ("last_executed",)},
    "shellbags": {"path": ("path",), "last_accessed": ("last_accessed",)},
    "file": {"path": ("FullPath", "path", "Path", "OSPath", "_Source", "Name")},
    "avlog": {c: (c,) for c in ("event_type", "timestamp", "threat_name", "file", "pid", "sha1", "sha256", "process", "files_accessed", "max_time_file", "estimated_impact_pct")},
    "content": {"rule": ("rule",), "severity": ("severity",), "mitre": ("mitre",), "description": ("description",), "filename": ("filename",), "matched": ("matched_strings",)},
    "textlog": {"raw": ("raw", "line"), "timestamp": ("timestamp",)},
}

#: Parts of artifact names, in order of preference, and the family that each leads to.
ROUTES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("yara_matches", "yara"), "content"), (("browser_history",), "generic"), (("zeek_", "bro_"), "textlog"), (("pslist", "process", "pstree"), "process"), (("dns",), "dns"), (("netstat", "network", "connection"), "network"),
    (("service", "executable"), "service"), (("eventlog_",), "event"), (("scheduledtask", "task", "command"), "task"), (("mplog",), "avlog"), (("sysmon",), "sysmon"), (("evtx", "eventlog", "event", "logon"), "event"),
    (("shimcache", "appcompatcache"), "shimcache"), (("userassist",), "userassist"), (("shellbag",), "shellbags"), (("prefetch", "amcache"), "execution"), (("registry", "run", "autorun", "startup"), "registry"),
    (("lnk", "shortcut"), "lnk"), (("searchglobs", "matches", "metadata", "upload"), "file"),
    (("syslog", "authlog", "auth_log", "apache", "nginx", "iis", "zeek", "bro", "suricata", "eve", "access_log", "textlog", "csv_log", "siem_export", "firewall_log"), "textlog"),
)


def family_of(artifact: Column) -> Column:
    """The family of an artifact by the first route with a part of its name; generic if none."""
    out = None
    for parts, family in ROUTES:
        hit = any_of([F.contains(F.lower(artifact), F.lit(p)) for p in parts])
        out = (F if out is None else out).when(hit, family)
    return out.otherwise("generic")


#: Columns of a family of which a table has a field each if it is of that family, whatever its name; the first that fits.
KEY_SETS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("sysmon", ("event_id", "Image", "ProcessId")), ("event", ("event_id", "time", "channel")), ("process", ("pid", "ppid", "name")), ("network", ("remote", "local", "state")), ("service", ("path", "start_mode")), ("task", ("command", "args", "name")),
    ("dns", ("domain", "qtype")), ("registry", ("key", "value")), ("lnk", ("target", "args")), ("userassist", ("path", "run_count")), ("shimcache", ("path", "last_modified")), ("shellbags", ("path", "last_accessed")),
    ("avlog", ("event_type", "threat_name")), ("content", ("rule", "severity", "filename")), ("textlog", ("raw", "timestamp")),
)


def families_by_keys(rows: DataFrame) -> DataFrame:
    """(host, artifact, family) of the artifacts whose fields make up a family's key set.

    An artifact's fields are brought together as one set by one aggregate; fields of a row are distinct before they are
    moved, and there are as many as the artifact has columns.
    """
    fields = rows.select("host", "artifact", F.explode(F.map_keys("row")).alias("field")).groupBy("host", "artifact").agg(F.collect_set("field").alias("fields"))
    fits = lambda family, columns: all_of([F.arrays_overlap("fields", F.array(*map(F.lit, FAMILIES[family][c]))) for c in columns])
    family = F.coalesce(*[F.when(fits(family, columns), family) for family, columns in KEY_SETS])
    return fields.select("host", "artifact", family.alias("family")).filter("family is not null")


def routed(rows: DataFrame) -> DataFrame:
    """rows with their family: by the artifact's name, and where that tells nothing by the fields of its rows."""
    named = rows.withColumn("family", family_of(F.col("artifact")))
    # One row for each artifact that no name claims.
    claimed = families_by_keys(named.filter("family = 'generic'")).withColumnsRenamed({"host": "__host", "artifact": "__artifact", "family": "__family"})
    joined = named.join(claimed, (F.col("family") == "generic") & F.col("host").eqNullSafe(F.col("__host")) & (F.col("artifact") == F.col("__artifact")), "left")
    return joined.withColumn("family", F.coalesce("__family", "family")).drop("__host", "__artifact", "__family")


def row_text(row: Column, most: int | None = None) -> Column:
    """All values of a row, parted by spaces."""
    text = F.concat_ws(" ", F.map_values(row))
    return text if most is None else F.substring(text, 1, most)


#: Normalisers of a user's own: (parts of artifact names, function from raw rows to canonical ones).
NORMALISERS: list[tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]] = []


def register_normaliser(artifact_parts: tuple[str, ...], normalise: Callable[[DataFrame], DataFrame]) -> None:
    """Raw rows of artifacts with one of these parts in their names are passed through the function before any family's
    columns are taken from them; the last one registered comes first."""
    NORMALISERS.insert(0, (tuple(artifact_parts), normalise))


def normalised(rows: DataFrame) -> DataFrame:
    """rows(host, artifact, row_index, source_file, row) after the registered normalisers, each row by the first that claims
    its artifact."""
    if not NORMALISERS:
        return rows
    claims = [any_of([F.contains(F.lower("artifact"), F.lit(p.lower())) for p in parts]) for parts, _ in NORMALISERS]
    claimed = rows.withColumn("__by", F.coalesce(*[F.when(hit, i) for i, hit in enumerate(claims)], F.lit(-1)))
    out = claimed.filter("__by = -1").drop("__by")
    for i, (_, normalise) in enumerate(NORMALISERS):
        out = out.unionByName(normalise(claimed.filter(F.col("__by") == i).drop("__by")).select(*out.columns))
    return out


def canonical(rows: DataFrame, family: str) -> DataFrame:
    """The family's columns as strings (empty if absent) with the place of the row; typed where the family has types."""
    row = F.col("row")
    out = rows.select(*PLACE, *[alias(row, *names).alias(c) for c, names in FAMILIES[family].items()], row_text(row).alias("data"), "row")
    if family == "process":
        out = out.withColumn("name", F.lower("name"))
    elif family == "network":
        port = F.coalesce(F.nullif("remote_port", F.lit("")).try_cast("int"), F.regexp_extract("remote", r":(\d+)$", 1).try_cast("int"))
        out = out.withColumns({"remote_port": port, "remote_ip": F.regexp_replace("remote", r":\d+$", "")})
    elif family == "event":
        out = out.withColumns({"event_id": F.col("event_id").try_cast("int"), "ts": parse_time(F.col("time")), "source_ip": F.nullif(F.regexp_extract(row_text(row), r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", 1), F.lit(""))})
    elif family == "sysmon":
        out = out.withColumns({"event_id": F.col("event_id").try_cast("int"), "port": F.nullif("DestinationPort", F.lit("")).try_cast("int")})
    return out.withColumn("row_index", F.col("row_index").cast("long"))


def normalised_events(rows: DataFrame) -> DataFrame:
    """Decoded event records with event_id, EventID, timestamp, provider, channel, computer and 800 characters of data;
    records without event id are dropped."""
    row = F.col("row")
    out = rows.withColumns({
        "event_id": alias(row, "EventID", "event_id", "Id", "ID", "id").try_cast("int"), "timestamp": alias(row, "TimeCreated", "timestamp", "Timestamp", "time"), "provider": alias(row, "provider", "Provider", "ProviderName"),
        "channel": alias(row, "Channel", "channel", "LogName"), "computer": alias(row, "Computer", "computer", "MachineName"), "data": row_text(row, 800),
    })
    return out.filter(F.col("event_id").isNotNull()).withColumn("EventID_text", F.col("event_id").cast("string"))


#: The events of a disk's logs that are worth keeping: logons and accounts, services and tasks, scripts, Sysmon.
INTERESTING_EVENTS = (4624, 4625, 4634, 4648, 4672, 4688, 4697, 4698, 4720, 4728, 4732, 4756, 7045, 7040, 1102, 4103, 4104, 1, 3, 5, 7, 8, 11, 12, 13, 15, 22, 23, 25)


def interesting(events: DataFrame) -> DataFrame:
    """The events(event_id, …) of INTERESTING_EVENTS."""
    return events.filter(F.col("event_id").isin(*INTERESTING_EVENTS))
