"""Correlation over a collection's canonical tables: timeline bursts, rare values, and the entity graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.scalars import alias, any_of, base_name, matches, parse_time
from tracehound.functions.tables import APPDATA_APPS, BOOT_PROCESSES, BURST_PROCESSES, LOGSOURCE_ARTIFACTS, SYSTEM_BINARIES, TIMESTAMP_FIELDS

from . import graph as G
from .aggregates import differing, rare, stack_counts
from .findings import emit, union
from .ordered import first_of_each, in_bursts, microseconds

c, lit = F.col, F.lit

#: Event ids of a boot, and networks that are no remote endpoints.
BOOT_EVENTS = (6005, 6006, 6009, 12, 13, 41)
LOCAL_NETWORKS = ("10.", "192.168.", "127.", "0.")
USER_WRITABLE = r"\\appdata\\|\\temp\\|\\users\\public\\|\\programdata\\|\\downloads\\"


#: Parts of artifact names, what an event of theirs is called, the fields that name it, whether only the last
#: part of the path is shown, how many characters from the front or (negative) the end, and the text without any.
DESCRIPTIONS = (
    (("event", "evtx"), "Event ", ("EventID", "event_id", "Id"), False, 40, "Log event"), (("process", "pslist"), "Process: ", ("Name", "name", "Image", "Exe"), True, 40, None), (("service",), "Service: ", ("Name", "name", "DisplayName"), False, 40, None),
    (("task",), "Task: ", ("Name", "name", "TaskName"), False, 40, None), (("netstat", "network"), "Conn: ", ("Raddr", "RemoteAddress", "remote"), False, 40, None), (("registry", "run", "autorun", "startup"), "Registry: ", ("Key", "KeyPath", "path", "Path", "Name", "name"), False, -50, "Registry change"),
    (("shimcache", "appcompatcache"), "Shimcache exec: ", ("path", "Path"), True, 40, "Shimcache entry"), (("userassist",), "GUI launch: ", ("path", "Path"), True, 40, "UserAssist entry"), (("shellbag",), "Browsed: ", ("path", "Path"), False, -40, "Shellbag entry"),
)


def event_description(artifact: Column, row: Column) -> Column:
    """A short text for an event of the timeline, by the artifact's family; its name where there is none."""
    out = None
    for parts, kind, names, last_part, most, without in DESCRIPTIONS:
        value = alias(row, *names)
        shown = F.substring_index(value, "\\", -1) if last_part else value
        shown = F.substring(shown, 1, most) if most > 0 else F.substring(shown, most, -most)
        text = F.concat(lit(kind), shown)
        text = text if without is None else F.when(value == "", without).otherwise(text)
        out = (F if out is None else out).when(any_of([F.contains(F.lower(artifact), lit(p)) for p in parts]), text)
    return out.otherwise(F.substring(artifact, 1, 30))


def first_events(events: DataFrame, most: int | None = 500) -> DataFrame:
    """The timeline in order of time, the first events of it or all."""
    ordered = events.orderBy("time", "host", "artifact", "row_index")
    return ordered if most is None else ordered.limit(most)


def frequency_summary(processes: DataFrame, network: DataFrame, top: int = 10) -> DataFrame:
    """(dimension, distinct, rare, top array<struct<n, value>>) of process names, their paths and remote addresses: how many
    values there are, how many of them once, and the most frequent."""
    names = processes.select(F.explode(F.array(F.struct(lit("process").alias("dimension"), c("name").alias("value")), F.struct(lit("path").alias("dimension"), F.lower("path").alias("value")))).alias("p")).select("p.*")
    counts = names.unionByName(network.select(lit("remote").alias("dimension"), c("remote_ip").alias("value"))).filter("value <> ''").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    most = first_of_each(counts, ["dimension"], [F.desc("n"), "value"], top).groupBy("dimension").agg(F.transform(F.array_sort(F.collect_list(F.struct((-c("n")).alias("k"), "value"))), lambda x: F.struct((-x["k"]).alias("n"), x["value"].alias("value"))).alias("top"))
    return counts.groupBy("dimension").agg(F.count("*").alias("distinct"), F.count_if(c("n") == 1).alias("rare")).join(most, "dimension")


def timeline(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """(host, artifact, row_index, time, name, event_id, description, has_finding) of every raw row with a time."""
    row = c("row")
    name = F.lower(base_name(alias(row, "Name", "name", "ProcessName", "Image", "Exe")))
    told = rows.select("host", "artifact", "row_index", parse_time(alias(row, *TIMESTAMP_FIELDS)).alias("time"), name.alias("name"), alias(row, "EventID", "event_id", "Id", "id").try_cast("int").alias("event_id"), event_description(c("artifact"), row).alias("description"), F.concat_ws(" ", F.map_values(row)).alias("text"))
    marks = findings.select("host", "artifact", "row_index").distinct().withColumn("has_finding", lit(True))
    return told.filter("time is not null").join(marks, ["host", "artifact", "row_index"], "left").withColumn("has_finding", F.coalesce("has_finding", lit(False)))


def boot_noise() -> Column:
    return c("name").isin(*BOOT_PROCESSES) | F.coalesce(c("event_id").isin(*BOOT_EVENTS), lit(False))


def timeline_bursts(events: DataFrame, window_us: int = 300_000_000, least: int = 3) -> DataFrame:
    """Bursts of a host's timeline that are worth a look: at least two artifacts, three events that are no boot noise,
    and a finding or a suspicious process. (host, start, end, n, artifacts, has_finding, severity)"""
    marked = in_bursts(
        events.select("host", "artifact", F.struct("artifact", "row_index").alias("tie"), microseconds(c("time")).alias("us"), (~boot_noise()).alias("real"), c("has_finding"), F.coalesce(c("name").isin(*BURST_PROCESSES), lit(False)).alias("odd")),
        ["host"], "us", "tie", window_us, least,
    )
    bursts = marked.groupBy("host", "__start").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"), F.sort_array(F.collect_set("artifact")).alias("artifacts"), F.bool_or("has_finding").alias("has_finding"), F.bool_or("odd").alias("odd"), F.count_if("real").alias("n_real"))
    kept = bursts.filter((F.size("artifacts") >= 2) & (c("n_real") >= 3) & (c("has_finding") | c("odd")))
    time = lambda x: F.timestamp_micros(c(x)).cast("timestamp_ntz")
    return kept.select("host", time("start_us").alias("start"), time("end_us").alias("end"), "n", "artifacts", "has_finding", F.when(c("has_finding") & (c("n") >= 10), "high").when(c("has_finding"), "medium").otherwise("low").alias("severity"))


def rare_paths(processes: DataFrame, most: int | None = 30) -> DataFrame:
    """Findings for programs seen once, in a place that users can write to, that are no known application."""
    path = F.lower("path")
    usual = any_of([path.rlike(p) for p in APPDATA_APPS])
    once = rare(stack_counts(processes.filter(matches(path, USER_WRITABLE) & ~usual), {"path": path}))
    once = once if most is None else once.orderBy("value").limit(most)
    return emit(once, "anomaly", "medium", F.concat(lit("Rare program path: "), base_name(c("value"))), c("value"), 45, "T1036", {"path": c("value")})


def rare_endpoints(network: DataFrame, dns: DataFrame, most: int | None = 30) -> DataFrame:
    """Findings for remote addresses and domains seen once, private networks aside."""
    local = any_of([c("remote_ip").startswith(p) for p in LOCAL_NETWORKS])
    values = network.filter(~local).select(c("remote_ip").alias("value")).unionByName(dns.select(F.lower("domain").alias("value")))
    once = rare(stack_counts(values, {"endpoint": c("value")}))
    once = once if most is None else once.orderBy("value").limit(most)
    return emit(once, "anomaly", "low", F.concat(lit("Rare remote endpoint: "), c("value")), c("value"), 30, "T1071", {"remote": c("value")})


def hash_mismatches(processes: DataFrame) -> DataFrame:
    """Findings for system programs that occur with more than one hash."""
    known = processes.withColumn("binary", base_name(c("name"))).filter(c("binary").isin(*SYSTEM_BINARIES) & (c("hash") != ""))
    return emit(differing(known, "binary", "hash"), "anomaly", "high", F.concat(lit("System program with several hashes: "), c("binary")), c("n_values").cast("string"), 75, "T1036.005", {"name": c("binary")})


def entity_graph(processes: DataFrame, network: DataFrame, dns: DataFrame, registry: DataFrame, tasks: DataFrame, services: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of processes, users, addresses, domains, files, registry keys, tasks and services of all hosts.

    A process is known by host and pid. What is set up to start is tied to the first process of the same program.
    """
    key = lambda kind, *cols: F.concat_ws("/", F.concat(lit(f"{kind}:"), F.coalesce(c(cols[0]).cast("string"), lit(""))), *[F.coalesce(c(x).cast("string"), lit("")) for x in cols[1:]])
    own = processes.filter("pid <> ''").withColumns({"id": key("process", "host", "pid"), "program": base_name(c("name"))})
    kept = network.filter("remote_ip <> ''").withColumns({"process_id": key("process", "host", "pid"), "id": key("ip", "remote_ip")})
    asked = dns.filter("domain <> ''").withColumn("id", key("domain", "domain"))
    set_up = union(*[df.filter(f"{name} <> ''").select("host", (c("pid") if "pid" in df.columns else lit("")).alias("pid"), F.lit(kind).alias("kind"), c(name).alias("label"), F.lower(F.regexp_extract(c(command), r'([^\\/\s"]+\.exe)', 1)).alias("program")) for df, kind, name, command in ((registry, "registry_key", "key", "value"), (tasks, "task", "name", "command"), (services, "service", "name", "path"))])
    set_up = set_up.withColumn("id", F.concat(c("kind"), lit(":"), c("host"), lit("/"), c("label")))
    as_node = lambda df, kind, label: df.select(F.struct(c("id"), c(label).cast("string").alias("label"), (kind if isinstance(kind, Column) else lit(kind)).alias("type")).alias("node"))
    users = own.filter("user <> ''").withColumn("id", key("user", "user"))
    # Files are known from what findings say of them.
    files = findings.filter(F.coalesce(c("evidence")["path"], lit("")) != "").select(F.lower(c("evidence")["path"]).alias("path")).distinct().select(key("file", "path").alias("id"), base_name(c("path")).alias("label"))
    nodes = G.nodes_of(as_node(files, "file", "label"), as_node(own, "process", "program"), as_node(users, "user", "user"), as_node(kept, "ip", "remote_ip"), as_node(asked, "domain", "domain"), as_node(set_up, c("kind"), "label"))
    ids = own.select("id").distinct()
    first = own.groupBy("host", "program").agg(F.min_by("id", "row_index").alias("process_id"))
    edges = G.edges_of(
        users.select(c("id").alias("source"), key("process", "host", "pid").alias("target"), lit("ran").alias("rel")),
        own.select(key("process", "host", "ppid").alias("source"), c("id").alias("target")).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").filter("source <> target").withColumn("rel", lit("spawned")),
        kept.join(ids.withColumnRenamed("id", "process_id"), "process_id", "left_semi").select(c("process_id").alias("source"), c("id").alias("target"), lit("connected").alias("rel")),
        *([asked.withColumn("process_id", key("process", "host", "pid")).join(ids.withColumnRenamed("id", "process_id"), "process_id", "left_semi").select(c("process_id").alias("source"), c("id").alias("target"), lit("resolved").alias("rel"))] if {"host", "pid"} <= set(dns.columns) else []),
        # By the pid that a row names, else by the first process of the same program.
        set_up.withColumn("named", key("process", "host", "pid")).join(ids.select(c("id").alias("named"), c("id").alias("by_pid")), "named", "left").join(first, ["host", "program"], "left").withColumn("process_id", F.coalesce("by_pid", "process_id")).filter("process_id is not null").select(c("process_id").alias("source"), c("id").alias("target"), lit("created").alias("rel")),
    )
    hits = findings.select("severity", F.explode(F.array_compact(F.array(F.when(F.coalesce(c("evidence")["path"], lit("")) != "", F.concat(lit("file:"), F.lower(c("evidence")["path"]))), F.when(c("evidence")["pid"].isNotNull(), F.concat_ws("/", F.concat(lit("process:"), c("host")), c("evidence")["pid"])), F.when(c("evidence")["remote"].isNotNull(), F.concat(lit("ip:"), F.regexp_replace(c("evidence")["remote"], r":\d+$", "")))))).alias("id"))
    return G.with_findings(nodes, hits), edges


def rule_artifacts(category: str) -> tuple[str, ...]:
    """Parts of artifact names that a rule category reads."""
    return tuple(LOGSOURCE_ARTIFACTS.get(category, ()))
