"""Queries for the report's operators, over findings and telemetry made of the supplied tables, with equal SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.operators import findings as fi
from tracehound.operators import report as P
from tracehound.operators import triage as T
from tracehound.operators.slices import packed
from tracehound.sources import canonical as K
from tracehound.sources import collection as S
from tracehound.sources.staging import shared_folder, table

from .queries import _KINDS_SQL, event_findings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_RANK = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end"
_F = f"f as (select event_id, user_id, ts, props, event_type, k.category, k.severity, k.score, k.mitre, 'Event ' || event_type as title, 'by ' || user_id as description from events join {_KINDS_SQL.replace(' as kinds', ' as k')} on event_type = kind)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# texts

#: The parts of categories in the order in which they are tried, restated for the SQL.
_PARTS = (
    "malware_signature", "malware", "hash_reputation", "correlated_risk", "process_anomaly", "process_name", "persistence", "credential_access", "defense_evasion", "network_anomaly", "network", "execution_evidence", "execution", "discovery", "sigma_detection",
    "suspicious_file", "suspicious", "anomaly", "yara",
)
_TEXTS = dict(P.MEANINGS)
_CATEGORIES = (*_PARTS, "Registry_Malware_x", "something", "network_anomaly_of_suspicious_file", "rare_anomaly", "yara_match")


@query(f"""with c as (select event_id, ({list(_CATEGORIES)})[(event_id % {len(_CATEGORIES)} + 1)::int] as category from events)
select event_id, category, case {' '.join(f"when contains(lower(category), '{p}') then '{_TEXTS[p].replace(chr(39), chr(39) * 2)}'" for p in _PARTS)} else '{P.DEFAULT_MEANING}' end as why from c""")
def q_meanings(spark, sf_dir):
    names = F.array(*map(F.lit, _CATEGORIES))
    rows = table(spark, sf_dir, "events").select("event_id", F.get(names, (F.col("event_id") % len(_CATEGORIES)).cast("int")).alias("category"))
    return rows.withColumn("why", P.meaning(F.col("category")))


@query(f"""with {_F}, c as (select user_id, count(*) filter (severity = 'high' and event_id % 40 = 0) as critical, count(*) filter (severity = 'high' and event_id % 3 = 0) as high, count(*) filter (event_id % 2 = 0) as findings from f group by user_id),
b as (select *, ['info', 'low', 'medium', 'high', 'critical'][user_id % 5 + 1] as base from c)
select user_id, case when critical > 0 then 'Act now: ' || critical || ' critical findings.' when high >= 3 then 'Likely incident: several findings of high severity.' when high > 0 then 'Look into the findings of high severity.' when findings > 0 then 'Only minor findings.' else 'No findings.' end as bottom_line,
  case when critical > 0 then 'critical' when high >= 3 and base <> 'critical' then 'high' when high >= 1 and base in ('low', 'info') then 'medium' else base end as severity from b""")
def q_bottom_line(spark, sf_dir):
    """The verdict in words, and the severity that an incident is lifted to, for each user's findings."""
    f = event_findings(spark, sf_dir).withColumn("id", F.col("row_index"))
    high = F.col("severity") == "high"
    m = f.groupBy(F.col("host").cast("long").alias("user_id")).agg(F.count_if(high & (F.col("id") % 40 == 0)).alias("critical"), F.count_if(high & (F.col("id") % 3 == 0)).alias("high"), F.count_if(F.col("id") % 2 == 0).alias("findings"))
    base = F.get(F.array(*map(F.lit, ("info", "low", "medium", "high", "critical"))), (F.col("user_id") % 5).cast("int"))
    return P.bottom_line(m).select("user_id", "bottom_line", P.incident_severity(base, F.col("critical"), F.col("high")).alias("severity"))


@query("""with e as (select event_id, unnest([{'o': 1, 'k': 'path', 'v': props}, {'o': 4, 'k': 'pid', 'v': event_id::varchar}, {'o': 7, 'k': 'domain', 'v': repeat('d', (event_id % 200)::int)}, {'o': 99, 'k': 'zz_field', 'v': event_type}]) as x from events)
select event_id, case x.k when 'path' then 'Path' when 'pid' then 'Pid' when 'domain' then 'Domain' else 'Zz Field' end as label, x.v as value, coalesce(length(x.v) > 120, false) or x.k = 'zz_field' as long, row_number() over (partition by event_id order by x.o) - 1 as place from e where x.v is not null""")
def q_evidence_fields(spark, sf_dir):
    held = F.map_from_arrays(F.array(*map(F.lit, ("zz_field", "domain", "pid", "path"))), F.array("event_type", F.repeat(F.lit("d"), (F.col("event_id") % 200).cast("int")), F.col("event_id").cast("string"), "props"))
    rows = table(spark, sf_dir, "events").select("event_id", P.evidence_fields(F.map_filter(held, lambda _, v: v.isNotNull())).alias("fields"))
    return rows.select("event_id", F.posexplode("fields").alias("place", "f")).select("event_id", "f.label", "f.value", "f.long", F.col("place").cast("long").alias("place"))


# Events worth keeping, snapshots, counts


@query("select event_id, (event_id % 5000)::int as kind from events where event_id % 5000 in (4624, 4625, 4634, 4648, 4672, 4688, 4697, 4698, 4720, 4728, 4732, 4756, 7045, 7040, 1102, 4103, 4104, 1, 3, 5, 7, 8, 11, 12, 13, 15, 22, 23, 25)")
def q_interesting_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("row"), (F.col("event_id") % 5000).cast("int").alias("event_id"))
    return K.interesting(rows).select(F.col("row").alias("event_id"), F.col("event_id").alias("kind"))


@query("select event_type as artifact, event_id, total, 100::bigint as kept from (select event_type, event_id, count(*) over (partition by event_type) as total, row_number() over (partition by event_type order by event_id) as n from events) where n <= 100 and total > 100")
def q_snapshot(spark, sf_dir):
    rows, cut = T.snapshot(table(spark, sf_dir, "events").select(F.col("event_type").alias("artifact"), "event_id"), 100, order="event_id")
    return rows.join(cut, "artifact").select("artifact", "event_id", "total", "kept")


@query(f"with {_F} select severity || '_detections' as name, count(*)::bigint as n from f group by 1 union all select lang || '_total_rows', count(*) from documents group by lang")
def q_detection_statistics(spark, sf_dir):
    return P.statistics(event_findings(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("lang").alias("artifact")))


@query("select 1::bigint as files, sum(length(event_type) + 1)::bigint as bytes, ['textlog'] as artifacts, count(*)::bigint as rows from events")
def q_collection_totals(spark, sf_dir):
    folder = f"{shared_folder(spark)}/collection-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select(F.col("event_type").alias("value")).repartition(1).write.text(f"{folder}/lines")
    return S.collection_totals(spark, f"{folder}/lines/*.txt", S.read_text(spark, f"{folder}/lines", pattern="*.txt"))


# A report's tables


@query("""with i as (select event_type as type, 'v' || event_id as value, round((event_id % 17) / 16.0, 4)::double as confidence, event_id % 3 = 0 as malicious from events)
select *, row_number() over (order by confidence desc, malicious desc, value) as place from i order by place limit 50""")
def q_ioc_order(spark, sf_dir):
    iocs = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"), F.round(F.col("event_id") % 17 / 16.0, 4).alias("confidence"), (F.col("event_id") % 3 == 0).alias("malicious"))
    return P.ordered_iocs(iocs).limit(50).withColumn("place", F.row_number().over(_in_order()).cast("long"))


def _in_order():
    from pyspark.sql import Window

    return Window.orderBy(F.monotonically_increasing_id())  # Fifty rows.


@query(f"with {_F}, n as (select *, row_number() over (order by {_RANK}, score desc, title, 'F-' || lpad(event_id::varchar, 9, '0')) as n from f) select n, '[' || upper(severity) || '] ' || title || ' - ' || description as line from n where n <= 200")
def q_summary_lines(spark, sf_dir):
    return P.summary_lines(event_findings(spark, sf_dir).withColumn("id", F.format_string("F-%09d", "row_index")))


@query(f"with {_F}, n as (select event_id, row_number() over (order by {_RANK}, score desc, title, event_id) as n from f) select event_id as row_index, 'F-' || case when n < 10000 then lpad(n::varchar, 4, '0') else n::varchar end as id from n")
def q_numbered_findings(spark, sf_dir):
    return fi.numbered(event_findings(spark, sf_dir)).select("row_index", "id")


@query("""with recursive u as (select user_id, least(count(*), 40)::bigint as n, row_number() over (order by user_id) as i from events group by user_id),
walk as (select i, n as used, 0::bigint as pack from u where i = 1 union all select u.i, case when w.used + u.n > 100 then u.n else w.used + u.n end, case when w.used + u.n > 100 then w.pack + 1 else w.pack end from walk w join u on u.i = w.i + 1)
select u.user_id, u.n, pack from walk w join u on u.i = w.i""")
def q_packed(spark, sf_dir):
    """Users' events, 40 of each at most, packed in order of users to lots of 100."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.least(F.count("*"), F.lit(40)).alias("n"))
    return packed(users, ["user_id"], "n", 100, "pack", "users-packed")


@query(f"""with recursive {_F.replace('f as (', 'f as materialized (')}, g as (select 'F-' || lpad(event_id::varchar, 9, '0') as id, {_RANK} as r, case when mitre = '' then 'F-' || lpad(event_id::varchar, 9, '0') else mitre end as key from f),
m as (select id, r, min(id) over (partition by key) as component, (row_number() over (partition by key order by id) - 1) // 300 as part from g),
p as (select component, part, count(*) as n, min(r) as r, row_number() over (order by min(r), count(*) desc, component, part) as i from m group by component, part),
walk as (select i, n as used, 0::int as batch from p where i = 1 union all select p.i, case when w.used + p.n > 300 then p.n else w.used + p.n end, case when w.used + p.n > 300 then w.batch + 1 else w.batch end from walk w join p on p.i = w.i + 1)
select id, batch from m join p on m.component = p.component and m.part = p.part join walk w on w.i = p.i""")
def q_finding_batches(spark, sf_dir):
    return P.batches(event_findings(spark, sf_dir).withColumn("id", F.format_string("F-%09d", "row_index")), 300)


@query(f"""with {_F}, gaps as (select event_id % 7 as q, case when event_id % 7 = 1 then 'cloud' when event_id % 7 = 2 then ' ' end as cloud, case when event_id % 7 in (1, 3) then 'local' end as own from events where event_id < 700)
select 'findings' as section, coalesce(severity, '') as part, count(*)::bigint as n from f group by 2 union all select 'finding_triage', ['benign', 'false_positive'][event_id % 2 + 1], count(*) from f where event_id % 5 = 0 group by 2
union all select 'knowledge_gaps', case when q = 1 then 'resolved_cloud' when q = 3 then 'resolved_local' else 'pending' end, count(*) from gaps group by 2
union all select 'anonymization', source, count(*) from documents group by 2 union all select 'iocs', type, count(*) from (select event_type as type from events where event_type = 'error') group by 2
union all select 'mitre_techniques', mitre, count(*) from f where mitre <> '' group by 2 union all select 'timeline', '', count(*) from events
union all select 'detection_statistics', name, n from ({ORACLES['q_detection_statistics'].replace('with ' + _F, '').strip()}) union all select 'metrics', 'Likely incident: several findings of high severity.', count(*) from f""")
def q_report_sections(spark, sf_dir):
    """All tables of a report, each as counts of its parts."""
    f = event_findings(spark, sf_dir).withColumn("id", F.col("row_index"))
    events, docs = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    seventh = F.col("event_id") % 7
    parts = {
        "iocs": events.filter("event_type = 'error'").select(F.col("event_type").alias("type"), F.col("event_id").cast("string").alias("value"), F.lit(0.5).alias("confidence"), F.lit(True).alias("malicious")), "techniques": f.filter("mitre <> ''").select(F.col("mitre").alias("technique"), F.col("score").alias("confidence")),
        "timeline": events.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("event")), "mapping": docs.select(F.col("source").alias("category")), "rows": docs.select(F.col("lang").alias("artifact")),
        "gaps": events.filter("event_id < 700").select(F.lit("q").alias("question"), F.lit("c").alias("category"), F.lit(1).alias("priority"), F.when(seventh == 1, "cloud").when(seventh == 2, " ").alias("cloud_answer"), F.when(seventh.isin(1, 3), "local").alias("local_answer")),
        "triage": f.filter("id % 5 = 0").select("id", F.get(F.array(F.lit("benign"), F.lit("false_positive")), (F.col("id") % 2).cast("int")).alias("verdict")),
    }
    tables = P.sections(f, f.groupBy("artifact").agg(F.count("*").alias("n")), parts)
    told = {"findings": ("severity", 1), "finding_triage": ("verdict", "n"), "knowledge_gaps": ("status", 1), "anonymization": ("category", "n"), "iocs": ("type", 1), "mitre_techniques": ("technique", 1), "timeline": (None, 1), "detection_statistics": ("name", "n"), "metrics": ("bottom_line", "findings")}
    out = None
    for name, (part, n) in told.items():
        counted = tables[name].groupBy((F.col(part) if part else F.lit("")).alias("part")).agg(F.sum(F.lit(1) if n == 1 else F.col(n)).alias("n")).select(F.lit(name).alias("section"), "part", F.col("n").cast("long").alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out
