"""Queries for hunts, timelines, lineage, rare values, log lines and registered parts, with equal SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.functions import scalars as V
from tracehound.functions.tables import BOOT_PROCESSES, LINEAGES
from tracehound.operators import correlation as C
from tracehound.operators import detectors as D
from tracehound.operators import findings as fi
from tracehound.operators import graph as G
from tracehound.operators import lineage as L
from tracehound.operators import redaction as X
from tracehound.operators import report as P
from tracehound.operators.hunt import Hunt, unclaimed
from tracehound.sources import avlog, canonical
from tracehound.sources.staging import table

from .detector_queries import in_list, pick, quoted, telemetry, telemetry_sql, text
from .later import E
from .queries import _KINDS_SQL, event_findings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_F = f"f as (select event_id, user_id, event_type, k.category, k.severity, k.score, k.mitre from events join {_KINDS_SQL.replace(' as kinds', ' as k')} on event_type = kind)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# hunts


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("props"), F.coalesce("props", F.lit("")))
    return table(spark, sf_dir, "events").select(F.lit("h").alias("host"), F.concat(F.lit("tbl_"), F.col("event_type")).alias("artifact"), F.col("event_id").alias("row_index"), F.lit("f").alias("source_file"), row.alias("row"))


@query(f"with {_F} select event_id as row_index, 'found' as part from f where severity = 'high' and contains(category, 'access') union all select event_id, 'inspected' from f where event_id = 41 union all select event_id, 'sliced' from events where event_type = 'view' and event_id between 100 and 250")
def q_hunt(spark, sf_dir):
    found = event_findings(spark, sf_dir).withColumn("id", F.concat(F.lit("F-"), F.col("row_index").cast("string")))
    hunt = Hunt(_event_rows(spark, sf_dir), found)
    parts = [hunt.find("HIGH", "Access", None).select("row_index", F.lit("found").alias("part")), hunt.finding("F-41").select("row_index", F.lit("inspected").alias("part")), hunt.slice("tbl_view", 100, 151).select("row_index", F.lit("sliced").alias("part"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select 'tbl_' || event_type as artifact, count(*)::bigint as n, event_type not in ('view', 'click') as unclaimed, contains(event_type, 'i') as similar from events group by event_type")
def q_hunt_artifacts(spark, sf_dir):
    rows = _event_rows(spark, sf_dir)
    hunt = Hunt(rows)
    left = unclaimed(rows, rows.filter("artifact in ('tbl_view', 'tbl_click')")).withColumn("unclaimed", F.lit(True))
    alike = hunt.similar_artifacts("I").withColumn("similar", F.lit(True))
    return hunt.artifacts().join(left, "artifact", "left").join(alike, "artifact", "left").fillna(False)


# The timeline

_line = {"Name": pick(["svchost.exe", "C:\\x\\evil.exe", "lsass.exe", "powershell.exe"]), "EventID": pick(["6005", "4624", "12", "1"], 4), "time": text("date_format(timestamp_seconds(1700000000 + event_id * 7 % 100000), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "strftime(to_timestamp(1700000000 + event_id * 7 % 100000) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ')")}


@query(f"""with {telemetry_sql(_line)}, n as (select *, lower(regexp_extract(Name, '([^\\\\]*)$', 1)) as base from t where event_at_all)
select row_index, row_index % 9 = 0 as has_finding, base in {in_list(BOOT_PROCESSES)} or EventID in ('6005', '12') as boot from n order by time, host, row_index limit 500""".replace(" where event_at_all", ""))
def q_timeline(spark, sf_dir):
    rows = telemetry(spark, sf_dir, "evtx_x", _line)
    found = rows.filter("row_index % 9 = 0").select("host", "artifact", "row_index")
    return C.first_events(C.timeline(rows, found)).select("row_index", "has_finding", C.boot_noise().alias("boot"))


# lineage

_TREE = ["winword.exe", "explorer.exe", "cmd.exe", "w3wp.exe", "procdump.exe", "whoami.exe", "Services.exe", "powershell.exe", "ncat.exe", "x.exe", "mshta.exe"]
_names_sql = "[" + ", ".join(f"({_TREE})[((event_id // {k}) % {len(_TREE)} + 1)::int]" for k in (1, 11, 7, 3)) + "][1:(event_id % 4 + 1)::int]"
_rules_sql = ", ".join(f"({i}, {list(map(str.lower, ups))}, {list(map(str.lower, downs))})" for i, (ups, downs) in enumerate(LINEAGES))


@query(f"""with ch as (select event_id as leaf, {_names_sql} as names from events), low as (select leaf, names, list_transform(names, lambda x: lower(x)) as low from ch),
p as (select leaf, i, low[i] as name, low, names from low, range(1, 5) t(i) where i <= len(low)), r(k, ups, downs) as (values {_rules_sql}),
hits as (select a.leaf, k, a.i as up, min(b.i) as down from p a join r on list_contains(ups, a.name) join p b on b.leaf = a.leaf and b.i > a.i and list_contains(downs, b.name) group by a.leaf, k, a.i),
best as (select leaf, arg_min(struct_pack(up := up, down := down), k * 10 + up) as b from hits group by leaf),
tool as (select leaf, arg_min(name, i) as tool from p where {' or '.join(f"contains(name, {quoted(t)})" for t in ('mimikatz.exe', 'procdump.exe', 'ncat.exe', 'psexec.exe'))} group by leaf)
select l.leaf, array_to_string(l.names, ' > ') as chain, coalesce(low[b.up] || ' > ' || low[b.down], tool) as label, len(l.names)::int as depth from low l left join best using (leaf) left join tool using (leaf)
where len(l.names) >= 2 and (len(l.names) >= 3 or coalesce(low[b.up], tool) is not null)""")
def q_process_trees(spark, sf_dir):
    at = lambda k: F.get(F.array(*map(F.lit, _TREE)), (F.floor(F.col("event_id") / k) % len(_TREE)).cast("int"))
    chains = table(spark, sf_dir, "events").select(F.col("event_id").alias("leaf"), F.slice(F.array(*[at(k) for k in (1, 11, 7, 3)]), 1, (F.col("event_id") % 4 + 1).cast("int")).alias("names"))
    trees = L.process_trees(chains.withColumn("depth", F.size("names")))
    return Hunt(trees, trees=trees).tree(most=None).select("leaf", "chain", "label", "depth")


# Values seen once

_once = {"Exe": text("concat('C:\\\\Users\\\\u\\\\AppData\\\\', CASE WHEN event_id % 3 = 0 THEN 'Local\\\\Slack\\\\' WHEN event_id % 3 = 1 THEN 'Local\\\\Odd\\\\' ELSE '' END, 'p', event_id % 700, '.exe')", "'C:\\Users\\u\\AppData\\' || case event_id % 3 when 0 then 'Local\\Slack\\' when 1 then 'Local\\Odd\\' else '' end || 'p' || event_id % 700 || '.exe'"), "Pid": text("event_id")}


@query(f"with {telemetry_sql(_once)}, n as (select lower(Exe) as path from t where row_index < 900 and not contains(lower(Exe), '\\local\\slack\\')) select 'Rare program path: ' || {'regexp_extract(path, ' + quoted('([^' + chr(92) * 2 + ']*)$') + ', 1)'} as title, path as description from n group by path having count(*) = 1")
def q_rare_paths(spark, sf_dir):
    rows = canonical.canonical(telemetry(spark, sf_dir, "pslist", _once).filter("row_index < 900"), "process")
    return C.rare_paths(rows, None).select("title", "description")


@query("""with v as (select case event_id % 5 when 0 then '10.0.0.' when 1 then '172.16.0.' when 2 then '8.8.' || event_id % 300 || '.' when 3 then '192.168.1.' else '127.0.0.' end || event_id % 200 as value from events where event_id < 800
union all select 'd' || event_id % 500 || '.com' from events where event_id < 800) select 'Rare remote endpoint: ' || value as title from v where not (starts_with(value, '10.') or starts_with(value, '192.168.') or starts_with(value, '127.') or starts_with(value, '0.')) group by value having count(*) = 1""")
def q_rare_endpoints(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("event_id < 800")
    head = F.get(F.array(F.lit("10.0.0."), F.lit("172.16.0."), F.concat(F.lit("8.8."), (F.col("event_id") % 300).cast("string"), F.lit(".")), F.lit("192.168.1."), F.lit("127.0.0.")), (F.col("event_id") % 5).cast("int"))
    network = events.select(F.concat(head, (F.col("event_id") % 200).cast("string")).alias("remote_ip"))
    dns = events.select(F.concat(F.lit("D"), (F.col("event_id") % 500).cast("string"), F.lit(".com")).alias("domain"))
    return C.rare_endpoints(network, dns, None).select("title")


# Log lines of the antivirus


@query("""with k as (select event_id, event_id % 5 as k from events where event_id % 11 <> 0)
select event_id as row_index, case k when 0 then 'detection' when 1 then 'ems_detection' when 2 then 'sdn' else 'estimated_impact' end as event_type, case k when 0 then 'Trojan:X/' || event_id when 1 then 'HackTool:Y' else '' end as threat_name, case k when 0 then 'C:\\a\\b' || event_id || '.exe' when 2 then 'D:\\c.dll' else '' end as file,
  case when k = 1 then event_id::varchar else '' end as pid, case when k = 2 then repeat('a', 40) else '' end as sha1, case when k = 3 then 'p' || event_id || '.exe' else '' end as process, case when k = 3 then (event_id % 90)::varchar else '' end as files_accessed, case when k = 3 then '9.5' else '' end as estimated_impact_pct from k where k < 4""")
def q_avlog_lines(spark, sf_dir):
    n = F.col("event_id").cast("string")
    lines = F.array(
        F.concat(F.lit("2021-07-22T15:38:04.557Z DETECTION_ADD Trojan:X/"), n, F.lit(" file:C:\\a\\b"), n, F.lit(".exe")), F.concat(F.lit("Engine:EMS detection: HackTool:Y, sigseq=0x1, pid="), n), F.lit("seen D:\\c.dll with sha1: " + "a" * 40 + " sha256: " + "b" * 64),
        F.concat(F.lit("2020-06-14T20:11:42.880Z ProcessImageName: p"), n, F.lit(".exe, TotalTime: 30, Count: "), (F.col("event_id") % 90).cast("string"), F.lit(", MaxTime: 15, MaxTimeFile: \\Device\\x->, EstimatedImpact: 9.5%")), F.lit("nothing of note"),
    )
    logs = table(spark, sf_dir, "events").select(n.alias("filename"), F.array(F.get(lines, (F.col("event_id") % 5).cast("int"))).alias("lines"), F.when(F.col("event_id") % 11 == 0, "denied").alias("error"))
    events, _ = avlog.expand_logs(logs)
    return events.select(F.col("source_file").cast("long").alias("row_index"), "event_type", "threat_name", "file", "pid", "sha1", "process", "files_accessed", "estimated_impact_pct")


# Parts of a user's own

_own = {"a": pick(["x", "y", "z"])}


@query(f"with {telemetry_sql(_own)} select row_index, 'mine' as title from t where a = 'x' union all select row_index, 'beside' from t where a = 'x' union all select row_index, 'normalised z' from t where a = 'z'")
def q_registered_parts(spark, sf_dir):
    engine = D.Engine()
    engine.detectors = {}
    rows = telemetry(spark, sf_dir, "custom_x", _own)
    engine.register(("custom_",), lambda r: fi.emit(r.filter(F.col("row")["a"] == "x"), "own", "low", "mine", "", 1))
    engine.register(("custom_x",), lambda r: fi.emit(r.filter(F.col("row")["a"] == "x"), "own", "low", "beside", "", 1), additional=True)
    engine.register(("custom_",), lambda r: fi.emit(r.filter(F.col("row")["b"] == "z"), "own", "low", F.concat(F.lit("normalised "), F.col("row")["b"]), "", 1), additional=True)
    canonical.register_normaliser(("custom_",), lambda r: r.withColumn("row", F.when(F.col("row")["a"] == "z", F.create_map(F.lit("b"), F.col("row")["a"])).otherwise(F.col("row"))))
    try:
        return engine.run(rows).select("row_index", "title")
    finally:
        canonical.NORMALISERS.pop(0)


# Merges, risk, path functions


@query("select event_id as value, 'known' as context from events where event_id % 3 = 0 union all select distinct on (event_id) event_id, 'new' from events where event_id % 2 = 0 and event_id % 3 <> 0")
def q_merge_new(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("value"))
    new = ids.filter("value % 2 = 0").withColumn("context", F.lit("new"))
    return P.merge_new(ids.filter("value % 3 = 0").withColumn("context", F.lit("known")), new.unionByName(new), "value")


@query("select user_id::varchar as original, '[U_' || user_id % 7 || ']' as anonymized from (select distinct user_id from events) union all select user_id::varchar, '[V_' || user_id % 5 || ']' from (select distinct user_id from events) where user_id % 2 = 0")
def q_merge_mappings(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    pairs = lambda kind, n: users.select(F.col("user_id").cast("string").alias("original"), F.concat(F.lit(f"[{kind}_"), (F.col("user_id") % n).cast("string"), F.lit("]")).alias("anonymized"))
    return X.merge_mappings(pairs("U", 7), pairs("V", 5).filter("cast(original as int) % 2 = 0").unionByName(pairs("U", 7).filter("cast(original as int) < 9")))


@query(f"""with {_F}, g as (select min(event_id) as component, count(*)::bigint as n, list_sort(list(distinct category)) as categories, sum(score)::bigint as total, min(case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end) as r from f where event_id % 4 = 0 group by user_id)
select component, n, categories, total, case when r = 0 then 'critical' else 'high' end as severity, least(total, 99)::int as score from g where len(categories) >= 2 and total >= 130""")
def q_entity_risk(spark, sf_dir):
    found = event_findings(spark, sf_dir).filter("row_index % 4 = 0")
    return G.entity_risk(found, "row_index", ["host"]).select("component", "n", "categories", "total", "severity", "score")


@query(r"""with p as (select page_id, 'C:\Users\Bob-7\' || case page_id % 4 when 0 then 'AppData\Acme Tools 2' when 1 then 'x1' when 2 then 'Temp\super_tool' else 'Program Files\Vendor%20Suite+' end || '\a%2Bb%ZZ.exe' as path from pages)
select page_id, case page_id % 4 when 0 then 'acmetools' when 2 then 'supertool' when 3 then 'vendorsuite' end as token, path as decoded from p""")
def q_path_functions(spark, sf_dir):
    middle = F.get(F.array(F.lit("AppData\\Acme Tools 2"), F.lit("x1"), F.lit("Temp\\super_tool"), F.lit("Program Files\\Vendor%20Suite+")), (F.col("page_id") % 4).cast("int"))
    path = F.concat(F.lit("C:\\Users\\Bob-7\\"), middle, F.lit("\\a%2Bb%ZZ.exe"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", V.tool_token(V.percent_decoded(F.replace("path", F.lit("%ZZ"), F.lit("")))).alias("token"), V.percent_decoded(F.col("path")).alias("decoded"))
