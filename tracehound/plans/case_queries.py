"""Queries for rules, descriptions, summaries and report tables, with equal SQL. Imported by queries.py, whose findings it uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracehound.functions.event_rules import BUILT_IN
from tracehound.operators import aggregates as A
from tracehound.operators import correlation as C
from tracehound.operators import redaction as X
from tracehound.operators import report as P
from tracehound.operators import retrieval as R
from tracehound.operators import rules as U
from tracehound.operators.findings import identity
from tracehound.sources import collection as S
from tracehound.sources import content as K
from tracehound.sources.canonical import canonical
from tracehound.sources.staging import shared_folder, table

from .detector_queries import COMMANDS, FOLDERS, NAMES, base, pick, quoted, telemetry, telemetry_sql, text
from .later import E
from .queries import _KINDS_SQL, event_findings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_F = f"f as (select event_id, user_id, event_type, k.* from events join {_KINDS_SQL.replace(' as kinds', ' as k')} on event_type = kind)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# The rules that come with the library

_rows = {
    "Image": (E.concat(pick(FOLDERS, 2)[0], pick(NAMES)[0]), f"{pick(FOLDERS, 2)[1]} || {pick(NAMES)[1]}"), "CommandLine": pick([*COMMANDS, "rundll32 url.dll,x", "psexec \\\\\\\\srv -u bob -accepteula", "x -e abc", "Add-MpPreference -ExclusionPath C:\\", "wmic shadowcopy delete", "IEX (New-Object Net.WebClient)"], 3), "ParentImage": (E.concat(E.lit("C:\\p\\"), pick(NAMES, 4)[0]), f"'C:\\p\\' || {pick(NAMES, 4)[1]}"),
    "ServiceFileName": pick(["C:\\Users\\Public\\s.exe", "C:\\Windows\\s.exe"], 5), "TargetObject": pick(["HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\x", "HKLM\\y"], 7), "Details": pick(["C:\\Temp\\z.exe", "ok"], 2), "EventID": pick(["1102", "104", "1", "4688"], 11), "CommandName": pick(["powershell x", "calc"], 6),
}


def _field_sql(spec: str, values) -> str:
    name, *how = spec.split("|")
    values = values if isinstance(values, list) else [values]
    low = f"lower(replace({name}, '\\', '/'))"
    one = {"contains": lambda v: f"contains({low}, {quoted(v)})", "endswith": lambda v: f"ends_with({low}, {quoted(v)})"}.get(how[0] if how else "", lambda v: f"lower({name}) = {quoted(v)}")
    return "(" + (" and " if "all" in how else " or ").join(one(str(v).lower().replace("\\", "/")) for v in values) + ")"


def _rule_sql(rule: U.Rule) -> str:
    parts = {k: "(" + " and ".join(_field_sql(f, v) for f, v in s.items()) + ")" for k, s in rule.detection.items() if k != "condition"}
    return " ".join(parts.get(word, word) for word in rule.condition.split())


@query(f"with {telemetry_sql(_rows)} " + " union all ".join(f"select row_index, {quoted(r.title)} as rule, '{U.LEVEL_SEVERITIES[r.level]}' as severity, {U.LEVEL_SCORES[r.level]}::int as score, '{r.technique}' as mitre from t where {_rule_sql(r)}" for r in BUILT_IN))
def q_builtin_rules(spark, sf_dir):
    return U.scan(telemetry(spark, sf_dir, "sysmon", _rows), list(BUILT_IN), raw="row", keep=("row_index",)).select("row_index", "rule", "severity", "score", "mitre")


# what a timeline says of an event

_artifacts = pick(["evtx_security", "pslist", "services", "scheduledtasks", "netstat", "registry_run", "shimcache", "userassist", "shellbags", "zzz_other_artifact_with_a_long_name"])
_told = {"artifact": _artifacts, "EventID": pick(["4624", ""], 10), "Name": pick(["C:\\x\\a_rather_long_program_name_of_more_than_forty_characters.exe", "b"], 20), "remote": pick(["1.2.3.4:5"]), "path": pick(["C:\\Users\\bob\\Some Folder\\Another Folder\\program.exe", ""], 30), "time": text("date_format(timestamp_seconds(1700000000 + event_id), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "''")}
_key = "coalesce(nullif(path, ''), nullif(Name, ''), '')"
_last = lambda v: f"regexp_extract({v}, '([^\\\\]*)$', 1)"


@query(f"""with {telemetry_sql(_told)} select row_index, case when contains(artifact, 'evtx') then case when EventID = '' then 'Log event' else 'Event ' || EventID end when artifact = 'pslist' then 'Process: ' || {_last('Name')}[1:40] when artifact = 'services' then 'Service: ' || Name[1:40]
when artifact = 'scheduledtasks' then 'Task: ' || Name[1:40] when artifact = 'netstat' then 'Conn: ' || remote when contains(artifact, 'registry') then 'Registry: ' || right({_key}, 50) when artifact = 'shimcache' then case when path = '' then 'Shimcache entry' else 'Shimcache exec: ' || {_last('path')}[1:40] end
when artifact = 'userassist' then case when path = '' then 'UserAssist entry' else 'GUI launch: ' || {_last('path')}[1:40] end when artifact = 'shellbags' then case when path = '' then 'Shellbag entry' else 'Browsed: ' || right(path, 40) end else artifact[1:30] end as description from t""")
def q_event_descriptions(spark, sf_dir):
    rows = telemetry(spark, sf_dir, "x", {k: v for k, v in _told.items() if k not in ("artifact", "time")} | {"timestamp": _told["time"]}).withColumn("event_id", F.col("row_index")).withColumn("artifact", _artifacts[0].make()).drop("event_id")
    return C.timeline(rows, event_findings(spark, sf_dir).limit(0)).select("row_index", "description")


# Summaries and views of findings


@query(f"with {_F} select mitre, count(*)::bigint as n from f where mitre <> '' group by mitre order by n desc, mitre limit 15")
def q_top_techniques(spark, sf_dir):
    return A.top_techniques(event_findings(spark, sf_dir))


@query(f"with {_F} select mitre, string_agg(title, '|' order by title) as titles from (select distinct mitre, 'Event ' || event_type as title from f) group by mitre")
def q_technique_titles(spark, sf_dir):
    return A.technique_titles(event_findings(spark, sf_dir)).withColumn("titles", F.array_join("titles", "|"))


@query("""with u as (select 'brand' as dimension, p_brand as value, p_partkey as place from part union all select 'size', p_size::varchar, p_partkey from part), r as (select *, row_number() over (partition by dimension, value order by place) as i from u where value <> '')
select dimension, value, count(*)::bigint as n, string_agg(place::varchar, ',' order by place) filter (i <= 5) as samples from r group by 1, 2""")
def q_stack_samples(spark, sf_dir):
    return A.stack_samples(table(spark, sf_dir, "part"), {"brand": F.col("p_brand"), "size": F.col("p_size")}, "p_partkey").withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


_seen = {"Name": pick(NAMES), "Exe": (E.concat(pick(FOLDERS, 3)[0], E.col("event_id").cast("string")), f"{pick(FOLDERS, 3)[1]} || event_id"), "remote": (E.concat(E.lit("10.0.0."), (E.col("event_id") * E.col("event_id") % 61).cast("string"), E.lit(":443")), "'10.0.0.' || (event_id * event_id % 61) || ':443'")}


@query(f"""with {telemetry_sql(_seen)}, u as (select 'process' as dimension, Name as value from t union all select 'path', lower(Exe) from t union all select 'remote', regexp_replace(remote, ':\\d+$', '') from t), k as (select dimension, value, count(*) as n from u group by 1, 2),
r as (select *, row_number() over (partition by dimension order by n desc, value) as i from k) select dimension, count(*)::bigint as distinct_values, (count(*) filter (n = 1))::bigint as rare, string_agg(value || '=' || n, ',' order by n desc, value) filter (i <= 10) as top from r group by dimension""")
def q_frequency_summary(spark, sf_dir):
    out = C.frequency_summary(canonical(telemetry(spark, sf_dir, "pslist", _seen), "process"), canonical(telemetry(spark, sf_dir, "netstat", _seen), "network"))
    return out.select("dimension", F.col("distinct").alias("distinct_values"), "rare", F.array_join(F.transform("top", lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), ",").alias("top"))


@query(r"select 'email' as category, count(distinct m)::bigint as n from (select unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) as m from documents) having count(*) > 0")
def q_mapping_counts(spark, sf_dir):
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0),)
    return P.count_by_category(X.dictionary(X.candidates(table(spark, sf_dir, "documents"), "doc_id", "text", patterns)))


@query(f"with {_F} select event_id as row_index, array_to_string(list_filter(['Event ' || event_type, 'by ' || user_id, category, mitre, severity, user_id::varchar, json_extract_string(props, '$.k')], lambda x: x is not null and x <> ''), ' ') as text from f join (select event_id, props from events) using (event_id)")
def q_finding_texts(spark, sf_dir):
    findings = event_findings(spark, sf_dir)
    return findings.select("row_index", R.finding_text(findings).alias("text"))


@query(f"with {_F} select event_id as row_index, severity from f where severity in ('critical', 'high') or not exists (select 1 from f where severity in ('critical', 'high'))")
def q_narrative_scope(spark, sf_dir):
    return P.in_scope(event_findings(spark, sf_dir), ("critical", "high")).select("row_index", "severity")


@query(f"with {_F} select event_id as row_index from f where severity = 'high' and contains(lower('Event ' || event_type || ' by ' || user_id || ' ' || category || ' ' || mitre || ' events'), 'credential')")
def q_finding_filter(spark, sf_dir):
    return P.matching(event_findings(spark, sf_dir), "HIGH", "Credential").select("row_index")


@query(f"with {_F} select event_id as row_index, case when event_id % 3 = 0 then 'closed' else 'new' end as status from f where event_id % 3 <> 0 or event_id % 2 = 1")
def q_triage_filter(spark, sf_dir):
    findings = event_findings(spark, sf_dir).withColumn("id", F.col("row_index").cast("string"))
    triage = table(spark, sf_dir, "events").filter("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 2 == 1, "closed").otherwise("ignored").alias("status"))
    return P.with_status(findings, triage, ("new", "closed")).select("row_index", "status")


@query("with c as (select event_type as cluster, event_id from events where event_id % 5 = 0), b as (select event_id, event_id // 100 as batch from events) select distinct b.batch::bigint as batch, cluster from c join b using (event_id)")
def q_cluster_batches(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    clusters = events.filter("event_id % 5 = 0").groupBy(F.col("event_type").alias("cluster")).agg(F.collect_set("event_id").alias("ids"))
    return P.clusters_of_batches(clusters, events.select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / 100).alias("batch")))


@query(f"""with {_F}, s as (select count(*)::bigint as findings, (count(*) filter (severity = 'high'))::bigint as high, (select count(*)::bigint from part) as iocs, (select count(*)::bigint from part where p_size > 25) as malicious_iocs from f),
h as (select user_id, bool_or(category = 'execution') ex, bool_or(category = 'persistence') pe, bool_or(category = 'network_anomaly') na from f group by 1) select s.*, (select coalesce(sum((ex and pe)::int + (na and ex)::int), 0)::bigint from h) as chains from s""")
def q_executive_metrics(spark, sf_dir):
    findings = event_findings(spark, sf_dir)
    iocs = table(spark, sf_dir, "part").select(F.col("p_name").alias("value"), (F.col("p_size") > 25).alias("malicious"))
    return P.executive_metrics(findings, iocs, A.chains(findings, ["host"])).select("findings", "high", "iocs", "malicious_iocs", "chains")


# What is written as a collection is read again

_logged = {"level": pick(["info", "WARN", "error", "debug", "fatal"]), "message": (E.concat(E.lit("m"), E.col("event_id").cast("string")), "'m' || event_id")}


@query(f"with {telemetry_sql(_logged)}, k as (select row_index, message, case when lower(level) in ('error', 'fatal') then 'error' when lower(level) = 'warn' then 'warning' end as kind from t) select kind as level, row_index, message from k where kind is not null qualify row_number() over (partition by kind order by row_index) <= 20")
def q_collection_log(spark, sf_dir):
    return S.collection_log(telemetry(spark, sf_dir, "log", _logged))


def _written(spark: SparkSession, df: DataFrame, form: str, name: str) -> str:
    import uuid

    path = f"{shared_folder(spark)}/collection-{uuid.uuid4().hex}/{name}"
    writer = df.write.option("header", "true") if form == "csv" else df.write
    getattr(writer, form)(path)
    return path


_JSON_SQL = "select event_id::varchar as event_id, event_type, user_id::varchar as user_id from events"


_EVENT = ("event_id", "event_type", "user_id")


def _event_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row")[k].alias(k) for k in _EVENT])


@query(_JSON_SQL)
def q_read_jsonl(spark, sf_dir):
    """Events written as JSON lines and read as raw rows."""
    lines = table(spark, sf_dir, "events").select(F.to_json(F.struct(*_EVENT)).alias("value"))
    out = _written(spark, lines, "text", "lines")
    return _event_rows(S.read_jsonl(spark, out, pattern="*.txt"))


@query("select text, event_type, (row_number() over (partition by event_type order by event_id) - 1)::bigint as row_index from (select event_id, event_type, 'a } { \"' || coalesce(props, '') || ' \\' as text from events)")
def q_read_json(spark, sf_dir):
    """Events written as one array of nested objects for each type, the texts with braces, quotes and backslashes, and read as
    raw rows with their places."""
    text = F.concat(F.lit('a } { "'), F.coalesce("props", F.lit("")), F.lit(" \\"))
    one = F.to_json(F.struct(F.struct(text.alias("text")).alias("deep"), "event_type"))
    events = table(spark, sf_dir, "events").withColumn("kind", F.col("event_type"))
    lines = events.select("kind", "event_id", F.concat(F.when(F.row_number().over(Window.partitionBy("kind").orderBy("event_id")) == 1, "[").otherwise(","), F.replace(one, F.lit(":{"), F.lit(":\n{"))).alias("value"))
    folder = f"{shared_folder(spark)}/collection-{_next()}/arrays"
    lines.repartition("kind").sortWithinPartitions("kind", "event_id").select("kind", "value").write.partitionBy("kind").text(folder)
    rows = S.read_json(spark, folder, pattern="*.txt")
    return rows.select(F.get_json_object(F.col("row")["deep"], "$.text").alias("text"), F.col("row")["event_type"].alias("event_type"), "row_index")


@query(_JSON_SQL)
def q_read_csv(spark, sf_dir):
    """Events written as CSV and read as raw rows by the header's names."""
    path = _written(spark, table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "csv", "events")
    return S.read_csv(spark, path).select(F.col("row")["event_id"].alias("event_id"), F.col("row")["event_type"].alias("event_type"), F.col("row")["user_id"].alias("user_id"))


@query("""with f as (select event_type, event_id, case event_id % 50 when 3 then 'sekurlsa' when 7 then 'MimiKatz' when 11 then 'beacon.dll' when 13 then 'reflectiveloader' when 17 then '%%import%%' else 'x' end as word from events)
select event_type as folder, 'SUSP_Mimikatz_Strings' as rule, ['sekurlsa', 'MimiKatz'] as matched_strings from f group by 1 having count(distinct word) filter (word in ('sekurlsa', 'MimiKatz')) = 2
union all select event_type, 'SUSP_CobaltStrike_Beacon_Indicators', ['beacon.dll', 'reflectiveloader'] from f group by 1 having count(distinct word) filter (word in ('beacon.dll', 'reflectiveloader')) = 2""")
def q_content_scan(spark, sf_dir):
    """A file for each event type, with words of the rules in some lines."""
    words = {3: "sekurlsa", 7: "MimiKatz", 11: "beacon.dll", 13: "reflectiveloader", 17: "%%import%%"}
    word = F.coalesce(*[F.when(F.col("event_id") % 50 == k, v) for k, v in words.items()], F.lit("x"))
    folder = f"{shared_folder(spark)}/collection-{_next()}/files"
    table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.concat(F.lit("q "), word, F.lit("\u00e9")).alias("value")).repartition("kind").write.partitionBy("kind").text(folder)
    found = K.scan_files(K.read_files(spark, folder, None, (".txt",)))
    return found.select(F.regexp_extract("filename", "kind=([^/]+)", 1).alias("folder"), "rule", "matched_strings")


@query("select md5('m' || user_id) as hash, case when user_id % 2 = 0 then 'note ' || user_id else '' end as note from (select distinct user_id from events) where user_id % 3 <> 0")
def q_read_hash_feed(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    line = F.when(F.col("user_id") % 3 == 0, F.lit("# comment")).when(F.col("user_id") % 2 == 0, F.concat(F.upper(F.md5(F.concat(F.lit("m"), F.col("user_id").cast("string")))), F.lit(",note "), F.col("user_id").cast("string"))).otherwise(F.md5(F.concat(F.lit("m"), F.col("user_id").cast("string"))))
    return S.read_hash_feed(spark, _written(spark, users.select(line.alias("value")), "text", "feed"))


@query("select event_type as event, count(*)::bigint as n from events group by 1")
def q_audit_totals(spark, sf_dir):
    path = f"{shared_folder(spark)}/audit-{abs(hash(sf_dir))}-{spark.sparkContext.applicationId}-{_next()}"
    S.append_audit(table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), "ts", "event_id"), path)
    return S.audit_totals(spark, path)


def _next() -> str:
    import uuid

    return uuid.uuid4().hex


@query("select max(event_id) as newest, count(*)::bigint as n from events where event_type = 'error'")
def q_incident_listing(spark, sf_dir):
    """Incidents are errors, the newest by id; listed, and counted by the same functions as a case store's."""
    incidents = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("event_id").alias("updated_at"))
    return S.list_incidents(incidents).limit(1).select(F.col("id").alias("newest")).crossJoin(S.count_incidents(incidents))  # One row each.


# The entity graph

_proc = {"Pid": text("event_id % 200"), "Ppid": text("event_id % 50"), "Name": pick(NAMES), "User": pick(["bob", "eve", ""], 3), "CommandLine": pick(COMMANDS, 2)}
_look = {"domain": (E.concat(E.lit("d"), (E.col("event_id") % 37).cast("string"), E.lit(".com")), "'d' || event_id % 37 || '.com'"), "Pid": text("event_id % 300")}
_plan = {"Name": (E.concat(E.lit("task"), (E.col("event_id") % 90).cast("string")), "'task' || event_id % 90"), "Command": pick(["C:\\x\\cmd.exe", "notepad.exe", "nothing.exe"], 2), "Pid": text("event_id % 400")}


def _as(name: str, sql: str) -> str:
    return f"{name} as ({sql[len('t as ('):-1]})"


@query(f"""with {_as('p', telemetry_sql(_proc))}, {_as('d', telemetry_sql(_look))}, {_as('k', telemetry_sql(_plan))}, ids as (select distinct host, Pid from p), firsts as (select host, Name as program, arg_min(Pid, row_index) as first_pid from p group by 1, 2),
e as (select distinct 'ran' as rel, 'user:' || "User" as source, host || '/' || Pid as target from p where "User" <> '' union select distinct 'spawned', p.host || '/' || p.Ppid, p.host || '/' || p.Pid from p join ids i on i.host = p.host and i.Pid = p.Ppid where p.Ppid <> p.Pid
union select distinct 'resolved', d.host || '/' || d.Pid, 'domain:' || domain from d join ids i on i.host = d.host and i.Pid = d.Pid
union select distinct 'created', k.host || '/' || coalesce(i.Pid, first_pid), 'task:' || k.host || '/' || k.Name from k left join ids i on i.host = k.host and i.Pid = k.Pid left join firsts f on f.host = k.host and f.program = {base('k.Command')} where i.Pid is not null or first_pid is not null)
select rel, count(*)::bigint as n from e group by rel""")
def q_entity_edges(spark, sf_dir):
    """Distinct edges of the entity graph by kind."""
    typed = lambda artifact, fields, family: canonical(telemetry(spark, sf_dir, artifact, fields), family)
    none = telemetry(spark, sf_dir, "none", _proc).limit(0)
    _, edges = C.entity_graph(typed("pslist", _proc, "process"), canonical(none, "network"), typed("dns", _look, "dns"), canonical(none, "registry"), typed("tasks", _plan, "task"), canonical(none, "service"), identity(event_findings(spark, sf_dir)).limit(0))
    return edges.select("rel", "source", "target").distinct().groupBy("rel").agg(F.count("*").alias("n"))
