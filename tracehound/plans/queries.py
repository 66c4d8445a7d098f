"""Queries over the supplied tables, one or more for each operator that these tables can feed, with equal SQL.

Events play authentication telemetry (error: failed logon, purchase and signup: success, user_id: account, props.k:
source), documents and pages text artifacts, conversations process ancestry, and the sales tables an entity graph.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.functions import scalars as S
from tracehound.functions.signatures import all_matches, first_match
from tracehound.functions.tables import COMMAND_SIGNATURES, TACTIC_ORDER, TECHNIQUE_TACTICS
from tracehound.operators import aggregates as A
from tracehound.operators import findings as fi
from tracehound.operators import graph as G
from tracehound.operators import lineage as L
from tracehound.operators import ordered as O
from tracehound.operators import redaction as X
from tracehound.operators import report as P
from tracehound.operators import retrieval as R
from tracehound.operators import rules as U
from tracehound.operators import triage as T
from tracehound.operators.hunt import Hunt
from tracehound.operators.text_index import TextIndex
from tracehound.sources.staging import shared_folder, spread, table
from tracehound.sources.store import KeyedStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"



def SOURCE(props: Column) -> Column:  # noqa: N802
    """The source that an event came from."""
    return F.get_json_object(props, "$.k")


#: How event types stand for finding categories, severities, scores and techniques.
KINDS = {"error": ("credential_access", "high", 65, "T1110"), "purchase": ("execution", "medium", 50, "T1059.001"), "signup": ("persistence", "high", 70, "T1136.001"), "click": ("network_anomaly", "low", 30, "T1071"), "view": ("discovery", "info", 10, "")}
_KINDS_SQL = "(values " + ", ".join(f"('{k}', '{c}', '{s}', {n}, '{m}')" for k, (c, s, n, m) in KINDS.items()) + ") as kinds(kind, category, severity, score, mitre)"


def _by_kind(at: int) -> Column:
    out = None
    for kind, values in KINDS.items():
        out = (F if out is None else out).when(F.col("event_type") == kind, F.lit(values[at]))
    return out


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a finding."""
    rows = table(spark, sf_dir, "events").withColumns({"artifact": F.lit("events"), "row_index": F.col("event_id"), "host": F.col("user_id").cast("string")})
    return fi.emit(rows, _by_kind(0), _by_kind(1), F.concat(F.lit("Event "), F.col("event_type")), F.concat_ws(" ", F.lit("by"), F.col("user_id").cast("string")), _by_kind(2), _by_kind(3), {"user": F.col("user_id"), "k": SOURCE(F.col("props"))})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{12,})"), F.lit(1))).alias("token"))


_HOST = r"://([^/?#]*)"


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", _HOST, 1)).alias("host"), F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"))


_HOSTS_SQL = "hosts as (select page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from pages)"


# Grouped detectors


@query("select user_id, count(*)::bigint as n from events where event_type = 'error' group by user_id having count(*) >= 5")
def q_bruteforce(spark, sf_dir):
    return A.over_threshold(_events(spark, sf_dir).filter("event_type = 'error'"), ["user_id"], 5)


@query("""select user_id, n, samples from (select user_id, count(*)::bigint as n from events where event_type = 'error' group by user_id having count(*) >= 5) c
join (select user_id, string_agg(event_id::varchar, ',' order by event_id) as samples from (select user_id, event_id, row_number() over (partition by user_id order by event_id) r from events where event_type = 'error') where r <= 5 group by user_id) s using (user_id)""")
def q_bruteforce_samples(spark, sf_dir):
    out = A.over_threshold(_events(spark, sf_dir).filter("event_type = 'error'"), ["user_id"], 5, F.col("event_id").cast("string"), "event_id")
    return out.withColumn("samples", F.array_join("samples", ","))


@query("""with p as (select distinct user_id, json_extract_string(props, '$.k') as k from events where event_type = 'purchase'), r as (select *, row_number() over (partition by user_id order by k) i from p where k is not null)
select user_id, count(*)::bigint as n_values, string_agg(k, ',' order by k) filter (i <= 5) as shown from r group by user_id having count(*) >= 3""")
def q_multi_source(spark, sf_dir):
    rows = _events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", SOURCE(F.col("props")).alias("k"))
    return A.many_values(rows, "user_id", "k", 3).withColumn("shown", F.array_join("shown", ","))


@query("select event_type, count(*)::bigint as n from events group by event_type order by n desc, event_type limit 20")
def q_event_distribution(spark, sf_dir):
    return A.distribution(_events(spark, sf_dir), "event_type")


@query("select * from (select user_id, count(*)::bigint as n from events where event_type = 'click' group by user_id order by n desc, user_id limit 10) where n >= 5")
def q_beacon_topk(spark, sf_dir):
    return A.top_then_least(_events(spark, sf_dir).filter("event_type = 'click'"), "user_id", 10, 5)


@query(f"with {_HOSTS_SQL} select * from (select array_to_string(string_split(host, '.')[-2:], '.') as domain, count(*)::bigint as n from hosts group by 1 order by n desc, domain limit 10) where n >= 10")
def q_domain_burst(spark, sf_dir):
    return A.top_then_least(_hosts(spark, sf_dir).withColumn("domain", S.registered_domain(F.col("host"))), "domain", 10, 10)


@query(f"with {_HOSTS_SQL} select array_to_string(string_split(host, '.')[-2:], '.') as domain, count(*)::bigint as n, count(distinct host)::bigint as n_hosts from hosts group by 1")
def q_registered_domain(spark, sf_dir):
    return _hosts(spark, sf_dir).groupBy(S.registered_domain(F.col("host")).alias("domain")).agg(F.count("*").alias("n"), F.count_distinct("host").alias("n_hosts"))


@query(f"with {_HOSTS_SQL} select host as value, count(*)::bigint as n from hosts group by host having count(*) = 1")
def q_rare_hosts(spark, sf_dir):
    return A.rare(A.stack_counts(_hosts(spark, sf_dir), {"host": F.col("host")})).select("value", "n")


@query("""select dimension, value, count(*)::bigint as n from (select 'brand' as dimension, p_brand as value from part union all select 'type', p_type from part union all select 'size', p_size::varchar from part) where value <> '' group by 1, 2""")
def q_stack_count(spark, sf_dir):
    return A.stack_counts(table(spark, sf_dir, "part"), {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size")})


@query("select source, count(distinct md5(text))::bigint as n_values from documents where text is not null group by source having count(distinct md5(text)) > 1")
def q_hash_mismatch(spark, sf_dir):
    return A.differing(table(spark, sf_dir, "documents").select("source", F.md5("text").alias("hash")), "source", "hash")


@query("""with ioc as (select md5(text) as hash, min(doc_id) as note from documents join labels using (doc_id) where toxic = 1 group by 1)
select hash, note, min(doc_id) as doc_id, count(*)::bigint as n from documents join ioc on md5(text) = hash group by 1, 2""")
def q_ioc_hash_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    bad = docs.join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id").groupBy("hash").agg(F.min("doc_id").alias("note"))
    return docs.join(bad, "hash").groupBy("hash", "note").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


# Findings


@query(f"""with f as (select event_id, user_id, event_type, k.* from events join {_KINDS_SQL.replace(' as kinds', ' as k')} on event_type = kind), r as (select *, row_number() over (partition by event_type order by event_id) i from f)
select 'Event ' || event_type as title, category, severity, mitre, min(event_id) as row_index, count(*)::bigint as occurrences, coalesce(string_agg('?#' || event_id, ',' order by event_id) filter (i between 2 and 11), '') as locators from r group by event_type, category, severity, mitre""")
def q_dedup_occurrences(spark, sf_dir):
    out = fi.dedup(event_findings(spark, sf_dir).drop("source_file"))
    return out.select("title", "category", "severity", "mitre", "row_index", "occurrences", F.array_join("occurrence_locators", ",").alias("locators"))


@query(f"""select count(*)::bigint as total, count(*) filter (severity = 'critical')::bigint as critical, count(*) filter (severity = 'high')::bigint as high, count(*) filter (severity = 'medium')::bigint as medium, count(*) filter (severity = 'low')::bigint as low, count(*) filter (severity = 'info')::bigint as info from events join {_KINDS_SQL} on event_type = kind""")
def q_severity_counts(spark, sf_dir):
    return fi.severity_counts(event_findings(spark, sf_dir))


@query(f"""with t(mitre0, tactic) as (values {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TECHNIQUE_TACTICS.items())}), o(tactic, tactic_order) as (values {", ".join(f"({_quoted(v)}, {i})" for i, v in enumerate(TACTIC_ORDER, 1))}),
f as (select mitre, severity, case when mitre = '' then 'Uncategorized' else coalesce(t.tactic, 'Other') end as tactic from events join {_KINDS_SQL} on event_type = kind left join t on split_part(mitre, '.', 1) = mitre0),
c as (select tactic, mitre, count(*)::bigint as n, min(case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end) as r from f group by 1, 2)
select c.tactic, mitre, n, ['critical', 'high', 'medium', 'low', 'info'][r + 1] as max_severity, (sum(n) over (partition by c.tactic))::bigint as tactic_total, coalesce(tactic_order, 99)::int as tactic_order from c left join o on c.tactic = o.tactic""")
def q_mitre_coverage(spark, sf_dir):
    return A.technique_coverage(event_findings(spark, sf_dir))


@query(f"""with f as (select user_id::varchar as host, category from events join {_KINDS_SQL} on event_type = kind), h as (select host, bool_or(category = 'execution') ex, bool_or(category = 'persistence') pe, bool_or(category = 'credential_access') ca, bool_or(category = 'network_anomaly') na from f group by host)
select host, array_to_string(list_filter([case when ex and pe then 'execution and persistence' end, case when na and ex then 'execution and network anomaly' end], lambda x: x is not null), ',') as chains, (ex::int + pe::int + ca::int)::int as n_stages, false as full_chain, 0::bigint as n_risk, false as ransomware from h""")
def q_chain_rules(spark, sf_dir):
    return A.chains(event_findings(spark, sf_dir), ["host"]).withColumn("chains", F.array_join("chains", ","))


@query(f"""select event_type, user_id, category, severity from events join {_KINDS_SQL} on event_type = kind order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end, score desc, event_type, event_id limit 100""")
def q_finding_order(spark, sf_dir):
    top = fi.in_order(event_findings(spark, sf_dir)).limit(100)
    return top.select(F.substring("title", 7, 20).alias("event_type"), F.col("host").cast("long").alias("user_id"), "category", "severity")


@query("select event_type, event_id, ts from events qualify row_number() over (partition by event_type order by ts, event_id) <= 5")
def q_topn_per_rule(spark, sf_dir):
    return O.first_of_each(_events(spark, sf_dir).select("event_type", "event_id", "ts"), ["event_type"], ["ts", "event_id"], 5)


@query("select user_id, count(*)::bigint as n, least(count(*), 20)::bigint as kept, greatest(count(*) - 20, 0)::bigint as truncated from events group by user_id")
def q_snapshot_cap(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "event_id")
    kept = O.first_of_each(rows, ["user_id"], ["event_id"], 20).groupBy("user_id").agg(F.count("*").alias("kept"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n")).join(kept, "user_id").withColumn("truncated", F.col("n") - F.col("kept"))


# Ordered detectors


@query("""with e as (select user_id, ts, event_id, (event_type = 'error')::int as f from events where event_type in ('error', 'purchase', 'signup')),
g as (select *, coalesce(sum(1 - f) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as g from e), n as (select *, sum(f) over (partition by user_id, g) as failures from g)
select user_id, ts, event_id, failures::bigint as failures from n where f = 0 and failures >= 3""")
def q_fail_streak_then_success(spark, sf_dir):
    auth = _events(spark, sf_dir).filter(F.col("event_type").isin("error", "purchase", "signup"))
    return O.failures_then_success(auth, "user_id", "ts", "event_id", F.col("event_type") == "error", F.col("event_type") != "error", 3)


@query("select user_id, event_id, hour(ts)::int as hour from events where event_type = 'purchase' and (hour(ts) >= 22 or hour(ts) < 5)")
def q_offhours(spark, sf_dir):
    return _events(spark, sf_dir).filter((F.col("event_type") == "purchase") & O.off_hours(F.col("ts"))).select("user_id", "event_id", F.hour("ts").alias("hour"))


def _burst_sql(key: str) -> str:
    return f"""with recursive e as (select {key} as k, ts, row_number() over o as i, count(*) over (partition by {key} order by ts range between current row and interval 5 minutes following) - (row_number() over o - rank() over (partition by {key} order by ts)) as n from events window o as (partition by {key} order by ts, event_id)),
walk as (select k, 1::bigint as i from (select distinct k from e) union all select w.k, case when e.n >= 3 then w.i + e.n else w.i + 1 end from walk w join e on e.k = w.k and e.i = w.i)
select a.k as {"user_id" if key == "user_id" else "day"}, a.ts as burst_start, b.ts as burst_end, a.n::bigint as n from walk w join e a on a.k = w.k and a.i = w.i join e b on b.k = a.k and b.i = a.i + a.n - 1 where a.n >= 3"""


@query(_burst_sql("ts::date"))
def q_burst_by_day(spark, sf_dir):
    return O.bursts(_events(spark, sf_dir).withColumn("day", F.to_date("ts")), ["day"], "ts", "event_id")


@query(_burst_sql("user_id"))
def q_burst_by_user(spark, sf_dir):
    return O.bursts(_events(spark, sf_dir), ["user_id"], "ts", "event_id")


@query("""with m as (select ts as mts, event_id as mid from events where event_type = 'signup' order by ts, event_id limit 1)
select event_id, ts, event_type from (select * from (select e.* from events e, m where (ts, event_id) < (mts, mid) order by ts desc, event_id desc limit 5) union all select * from (select e.* from events e, m where (ts, event_id) >= (mts, mid) order by ts, event_id limit 6))""")
def q_timeline_neighbourhood(spark, sf_dir):
    return O.neighbourhood(_events(spark, sf_dir), "ts", "event_id", F.col("event_type") == "signup", 5).select("event_id", "ts", "event_type")


# Text


#: Patterns that both regular expression dialects read alike.
TEXT_SIGNATURES = (
    (r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "email address", "medium"),
    (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "IPv4 address", "low"),
    (r"(password|api_?key|token)\s*[=:]\s*\S+", "secret", "high"),
    (r"licen[sc]ed? under", "license line", "info"),
)


def _signature_sql(table_, extra: str = "") -> str:
    parts = ", ".join(f"{{'n': {i}, 'label': {_quoted(label)}, 'severity': '{sev}', 'hit': regexp_matches(text, {_quoted('(?i)' + p)}), 'len': length(regexp_extract(text, {_quoted('(?i)' + p)}))}}" for i, (p, label, sev) in enumerate(table_))
    return f"select doc_id, m.n, m.label, m.severity, m.len from (select doc_id, unnest([{parts}]) as m from documents) where m.hit{extra}"


@query(f"select doc_id, label, severity from ({_signature_sql(TEXT_SIGNATURES)})")
def q_signatures_all(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(all_matches(F.col("text"), TEXT_SIGNATURES)).alias("m")).select("doc_id", "m.label", "m.severity")


@query(f"select doc_id, arg_min(label, n) as label, arg_min(severity, n) as severity from ({_signature_sql(TEXT_SIGNATURES)}) group by doc_id")
def q_signatures_first(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", first_match(F.col("text"), TEXT_SIGNATURES).alias("m")).filter("m is not null").select("doc_id", "m.label", "m.severity")


@query(f"select doc_id, arg_min(label, n) as label, arg_min(severity, n) as severity from ({_signature_sql(TEXT_SIGNATURES, ' and m.len >= 16')}) group by doc_id")
def q_signatures_minlen(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", first_match(F.col("text"), TEXT_SIGNATURES, least=16).alias("m")).filter("m is not null").select("doc_id", "m.label", "m.severity")


@query(f"select doc_id, label, severity from ({_signature_sql(COMMAND_SIGNATURES)})")
def q_signatures_commands(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(all_matches(F.col("text"))).alias("m")).select("doc_id", "m.label", "m.severity")


@query("""with t as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{12,}')) as token from documents),
f as (select token, list_sum(list_transform(list_distinct(string_split(token, '')), lambda c: -((length(token) - length(replace(token, c, ''))) / length(token)::double) * log2((length(token) - length(replace(token, c, ''))) / length(token)::double))) as e,
  length(regexp_replace(token, '[^aeiou]', '', 'g')) / length(token)::double as v, list_max(list_transform(regexp_extract_all(token, '[b-df-hj-np-tv-z]+'), lambda x: length(x))) as c from t)
select token, round(e, 6) as entropy, round(v, 6) as vowels, coalesce(c, 0)::int as consonants from f where (e >= 3.6)::int + (v <= 0.25)::int + (coalesce(c, 0) >= 5)::int >= 2""")
def q_dga_tokens(spark, sf_dir):
    t = _tokens(spark, sf_dir).select("token").distinct().filter(S.looks_generated(F.col("token")))
    return t.select("token", F.round(S.entropy(F.col("token")), 6).alias("entropy"), F.round(S.vowel_ratio(F.col("token")), 6).alias("vowels"), S.consonant_run(F.col("token")).alias("consonants"))


@query("select doc_id, token from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{12,}')) as token from documents) where length(token) > 20")
def q_long_token(spark, sf_dir):
    return _tokens(spark, sf_dir).filter(F.char_length("token") > 20)


@query(f"with {_HOSTS_SQL}, f as (select page_id, host, regexp_extract(replace(host || path, '/', '\\'), '^(.*)\\\\[^\\\\]*$', 1) as folder from hosts) select folder, count(*)::bigint as n, min(page_id) as first_page from f where length(folder) >= 15 group by folder having count(*) >= 2")
def q_folder_clusters(spark, sf_dir):
    rows = _hosts(spark, sf_dir).select(F.col("page_id").alias("id"), F.create_map(F.lit("path"), F.concat("host", "path")).alias("evidence"))
    return P.folder_clusters(rows).select("folder", "n", F.array_min("ids").alias("first_page"))


@query(f"with {_HOSTS_SQL}, f as (select page_id, regexp_replace(split_part(host, '.', 1), '[^a-z]', '', 'g') as token from hosts) select token, count(*)::bigint as n from f where length(token) >= 5 group by token having count(*) >= 2")
def q_token_clusters(spark, sf_dir):
    path = F.concat(F.regexp_extract("host", r"^([^.]*)", 1), F.lit("/x"))
    rows = _hosts(spark, sf_dir).select(F.col("page_id").alias("id"), F.create_map(F.lit("path"), path).alias("evidence"))
    return P.tool_clusters(rows).select("token", "n")


@query("select doc_id, lang from documents where lower(concat_ws(' ', text, lang, source)) like '%licensed under%'")
def q_search(spark, sf_dir):
    return R.contains(table(spark, sf_dir, "documents"), ["text", "lang", "source"], "Licensed UNDER").select("doc_id", "lang")


@query("select doc_id, lang from documents where contains(lower(concat_ws(' ', text, lang, source)), 'licensed under cc by')")
def q_search_indexed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    index = TextIndex.build(docs.select("doc_id", "lang", "source", "text"), F.concat_ws(" ", "text", "lang", "source"), blocks=32)
    return index.search("Licensed UNDER CC BY").select("doc_id", "lang")


@query("""select needle, count(*)::bigint as n, case when count(*) <= 3 then 'rare' when count(*) <= 20 then 'uncommon' else 'common' end as class, list_sort(list(distinct lang)) as artifacts
from documents join (values ('licensed under cc by'), ('@'), ('the ed and')) v(needle) on contains(lower(text), needle) group by needle""")
def q_frequency_indexed(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("artifact"), F.create_map(F.lit("text"), F.coalesce("text", F.lit(""))).alias("row"))
    hunt = Hunt(rows).indexed(blocks=32)
    found = [hunt.frequency(text).withColumn("needle", F.lit(text)) for text in ("licensed under cc by", "@", "the ed and")]
    return reduce(DataFrame.unionByName, found).filter("n > 0").select("needle", "n", "class", "artifacts")


@query("select user_id, n, case when n <= 3 then 'rare' when n <= 20 then 'uncommon' else 'common' end as class from (select user_id, count(*)::bigint as n from events group by user_id)")
def q_frequency_class(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).withColumn("class", R.frequency_class(F.col("n")))


@query(r"select doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '[IP]', 'g')) as redacted_md5 from documents")
def q_redact_email_ip(spark, sf_dir):
    text = F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace(text, r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "[IP]")).alias("redacted_md5"))


_EMAIL = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0),)


@query(r"""with v as (select distinct unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) as original from documents)
select original, 'email' as category, '[EMAIL_' || row_number() over (order by original) || ']' as anonymized from v""")
def q_redact_dictionary(spark, sf_dir):
    return X.dictionary(X.candidates(table(spark, sf_dir, "documents"), "doc_id", "text", _EMAIL))


@query(r"select doc_id, md5(text) as restored_md5, 0::bigint as left_over, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))::bigint as hidden from documents")
def q_redact_and_restore(spark, sf_dir):
    """Restored texts, and how many addresses and placeholders the redacted ones hold."""
    hidden, mapping = X.redact(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", patterns=_EMAIL)
    counts = hidden.select("doc_id", F.regexp_count("redacted", F.lit(_EMAIL[0][1])).cast("long").alias("left_over"), F.regexp_count("redacted", F.lit(r"\[EMAIL_\d+\]")).cast("long").alias("hidden"))
    return X.restore(hidden.select("doc_id", "redacted"), "doc_id", "redacted", mapping).select("doc_id", F.md5("restored").alias("restored_md5")).join(counts, "doc_id")


#: A value of every pattern's category by two numbers, %u and %w, and values that lie within it.
_IDENTIFIERS = (
    ("ad_identity", "CORP\\u%u"), ("upn_identity", "n%u@site.local", ("internal_fqdn", "site.local")), ("sid", "S-1-5-21-100000001-100000002-100000003-%u"), ("private_ip", "10.1.%w.7"), ("private_ip", "172.16.%w.8"), ("private_ip", "192.168.%w.9"),
    ("private_ip", "169.254.%w.10"), ("public_ip", "93.184.%w.34"), ("ipv6", "2001:db8:1:2:3:4:5:%w"), ("private_ipv6", "fd12:a%w"), ("mac_address", "00-1A-2B-3C-4D-%w"), ("subnet", "192.168.%w.0/24", ("private_ip", "192.168.%w.0")),
    ("unc_path", "\\\\srv\\share%u"), ("user_path_win", "C:\\Users\\p%u"), ("user_path_linux", "/home/h%u"), ("registry_user", "HKEY_USERS\\9%u"), ("ldap_dn", "CN=a%u,OU=x"), ("gpo_guid", "{00000000-0000-0000-0000-0000000000%w}"),
    ("email", "e%u@mail.zz"), ("internal_fqdn", "srv%u.intra"), ("external_fqdn", "x%u.example.biz"), ("computer_name", "SRV-A%u", ("hostname", "A%u")), ("hostname", "HX%u"),
)


def _identifier_sql(template: str) -> str:
    return "'" + template.replace("%u", "' || u || '").replace("%w", "' || w || '") + "'"


def _identifier(template: str) -> Column:
    return F.concat(*[F.col(p[1]) if p in ("%u", "%w") else F.lit(p) for p in re.split("(%u|%w)", template) if p])


_NUMBERS_SQL = "n as (select event_id, (1000 + user_id)::varchar as u, (10 + user_id % 80)::varchar as w from events)"
_LISTED_SQL = ", ".join(f"{{'i': {i}, 'category': '{c}', 'value': {_identifier_sql(t)}}}" for i, (c, t, *inner) in enumerate(_IDENTIFIERS))
_INNER_SQL = ", ".join(f"{{'i': -1, 'category': '{c}', 'value': {_identifier_sql(t)}}}" for _, _, *inner in _IDENTIFIERS for c, t in inner)


@query(f"""with {_NUMBERS_SQL}, held as (select event_id, unnest([{_LISTED_SQL}, {_INNER_SQL}]) as h from n),
numbered as (select value, '[' || upper(category) || '_' || row_number() over (partition by category order by value) || ']' as shown from (select distinct h.category, h.value from held))
select event_id, string_agg(shown, ';' order by h.i) as redacted from held join numbered on h.value = numbered.value where h.i >= 0 group by event_id""")
def q_redact_identifiers(spark, sf_dir):
    """Every category of identifiers in each row, some of them within others; restored again where that gives the text."""
    numbers = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") + 1000).cast("string").alias("u"), (F.col("user_id") % 80 + 10).cast("string").alias("w"))
    texts = numbers.select("event_id", F.concat_ws(";", *[_identifier(t) for _, t, *_ in _IDENTIFIERS]).alias("text"))
    hidden, mapping = X.redact(texts, "event_id", "text")
    back = X.restore(hidden, "event_id", "redacted", mapping)
    return back.filter("restored = text").select("event_id", "redacted")


@query("select doc_id, lang, used from (select doc_id, lang, (sum(length(text) + 1) over (partition by lang order by doc_id))::bigint as used from documents) where used <= 60000")
def q_context_budget(spark, sf_dir):
    return R.within_budget(table(spark, sf_dir, "documents"), "text", "doc_id", 60000, ["lang"]).select("doc_id", "lang", "used")


# Rules


def _rule(title: str, detection: dict, **more) -> U.Rule:
    return U.Rule(title, detection, **more)


@query("select event_id from events where event_type = 'error'")
def q_sigma_equals(spark, sf_dir):
    return U.scan(_events(spark, sf_dir), [_rule("failed", {"s": {"event_type": "ERROR"}, "condition": "s"})], keep=("event_id",)).select("event_id")


@query("select doc_id from documents where lower(text) like '%licensed%' and lower(text) like '%under%'")
def q_sigma_contains_all(spark, sf_dir):
    return U.scan(table(spark, sf_dir, "documents"), [_rule("both", {"s": {"text|contains|all": ["Licensed", "under"]}, "condition": "s"})], keep=("doc_id",)).select("doc_id")


@query("select event_id from events where (event_type = 'error' or event_type = 'click') and not (user_id = 7 or props is null)")
def q_sigma_not_filter(spark, sf_dir):
    rule = _rule("filtered", {"s": [{"event_type": "error"}, {"event_type": "click"}], "f": [{"user_id": 7}, {"props": None}], "condition": "s and not f"})
    return U.scan(_events(spark, sf_dir), [rule], keep=("event_id",)).select("event_id")


@query("select doc_id, rule, score from (select doc_id, 'starts' as rule, 60::int as score from documents where starts_with(lower(text), 'the ') or contains(lower(text), 'licensed under') union all select doc_id, 'source', 25::int from documents where lower(source) like '%5' and lang = 'en')")
def q_sigma_one_of(spark, sf_dir):
    rules = [
        _rule("starts", {"sel_a": {"text|startswith": "The "}, "sel_b": {"text|contains": "licensed under"}, "condition": "1 of sel_*"}, level="high"),
        _rule("source", {"sel_a": {"source|endswith": "5"}, "sel_b": {"lang": "EN"}, "condition": "all of them"}, level="low"),
    ]
    return U.scan(table(spark, sf_dir, "documents"), rules, keep=("doc_id",)).select("doc_id", "rule", "score")


@query(r"""with a as (select doc_id, unnest(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) as ip from documents) select doc_id, ip from a where split_part(ip, '.', 1)::int = 11 or split_part(ip, '.', 1)::int between 108 and 111 or (split_part(ip, '.', 1)::int = 233 and split_part(ip, '.', 2)::int = 233)""")
def q_sigma_cidr(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"), F.lit(0))).alias("ip"))
    return U.scan(rows, [_rule("networks", {"s": {"ip|cidr": ["11.0.0.0/8", "108.0.0.0/6", "233.233.0.0/16"]}, "condition": "s"})], keep=("doc_id", "ip")).select("doc_id", "ip")


#: Four thousand rules over documents: a piece of a word made of three syllables, and by the number's remainder to 5 where it
#: stands or what must not hold beside it.
_SYLLABLES = ("th", "er", "an", "in", "on", "re", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st")
_MANY_RULES = 4000


def _many_rules() -> list[U.Rule]:
    rules = []
    for i in range(_MANY_RULES):
        part = _SYLLABLES[i % 20] + _SYLLABLES[i // 20 % 20] + _SYLLABLES[i // 400]
        s = {0: {"text|contains": part.upper()}, 1: {"text|contains": part}, 2: {"text|startswith": part}, 3: {"text|re": part + "[a-z]+\\."}, 4: {"text|contains|all": [part, " the "]}}[i % 5]
        detection = {"s": s, "f": {"lang": ["EN", "de"]}, "g": {"source|endswith": "7"}, "condition": "s and not (f or g)" if i % 5 == 1 else "s and 1 of g*" if i % 5 == 0 else "s"}
        rules.append(_rule(f"r{i}", detection, level=("high", "low")[i % 2]))
    return rules


@query(f"""with s as (select {list(_SYLLABLES)} as s), r as (select i, s[i % 20 + 1] || s[i // 20 % 20 + 1] || s[i // 400 + 1] as part from s, range({_MANY_RULES}) t(i)),
d as (select doc_id, lang, source, lower(text) as low from documents),
hits as (select i, doc_id from r join d on contains(low, part) where case i % 5
  when 0 then source like '%7' when 1 then not (coalesce(lang in ('en', 'de'), false) or coalesce(source like '%7', false)) when 2 then starts_with(low, part)
  when 3 then regexp_matches(low, part || '[a-z]+\\.') else contains(low, ' the ') end)
select 'r' || i as rule, case when i % 2 = 0 then 60 else 25 end::int as score, count(*)::bigint as n, min(doc_id) as first_doc, max(doc_id) as last_doc from hits group by i""")
def q_rules_indexed(spark, sf_dir):
    found = U.scan(spread(table(spark, sf_dir, "documents")), _many_rules(), keep=("doc_id",))
    return found.groupBy("rule", "score").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("select severity, category, count(*)::bigint as n from (select case when event_type = 'error' then 'high' else 'low' end as severity, case when event_type = 'view' then 'process_anomaly' else 'other' end as category from events) where not (severity = 'low' and category = 'process_anomaly') group by 1, 2")
def q_allowlist(spark, sf_dir):
    rows = _events(spark, sf_dir)
    found = fi.emit(rows, F.when(F.col("event_type") == "view", "process_anomaly").otherwise("other"), F.when(F.col("event_type") == "error", "high").otherwise("low"), "t", "d", 1, evidence={"path": F.lit("C:\\Windows\\System32\\svchost.exe")})
    return fi.apply_allowlist(found)[0].groupBy("severity", "category").agg(F.count("*").alias("n"))


# Joins, lineage, graph


@query("""with recursive up as (select conv_id, turn as leaf, turn as at, 1 as depth, role as chain from conversations union all
select u.conv_id, u.leaf, c.turn, u.depth + 1, c.role || ' > ' || u.chain from up u join conversations c on c.conv_id = u.conv_id and c.turn = u.at - 1 where u.depth < 13)
select conv_id, leaf, max(depth)::int as depth, arg_max(chain, depth) as chain from up group by conv_id, leaf""")
def q_ancestry(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") - 1).alias("before"), F.col("role").alias("name"))
    out = L.ancestry(rows, ["conv_id"], "turn", "before", "name", "turn")
    return out.select("conv_id", "leaf", "depth", F.array_join("names", " > ").alias("chain"))


@query("select c.conv_id, c.turn, c.role, p.role as parent_name from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1")
def q_parent_name(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") - 1).alias("before"), "role")
    return L.with_parent(rows, ["conv_id"], "turn", "before", "role", "turn").select("conv_id", "turn", "role", "parent_name")


def _graph(spark, sf_dir):
    customer, nation, orders, supplier = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders", "supplier"))
    nodes = G.nodes_of(
        customer.select(G.node("user", F.col("c_custkey"), F.col("c_name")).alias("node")), nation.select(G.node("domain", F.col("n_nationkey"), F.col("n_name")).alias("node")),
        orders.select(G.node("process", F.col("o_orderkey")).alias("node")), supplier.select(G.node("service", F.col("s_suppkey"), F.col("s_name")).alias("node")),
    )
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edges = G.edges_of(
        customer.select(key("user", "c_custkey").alias("source"), key("domain", "c_nationkey").alias("target"), F.lit("lives").alias("rel")),
        orders.select(key("user", "o_custkey").alias("source"), key("process", "o_orderkey").alias("target"), F.lit("ran").alias("rel")),
        supplier.select(key("service", "s_suppkey").alias("source"), key("domain", "s_nationkey").alias("target"), F.lit("located").alias("rel")),
    )
    return nodes, edges


_GRAPH_SQL = """nodes as (select 'user:' || c_custkey as id, c_name as label, 'user' as type from customer union all select 'domain:' || n_nationkey, n_name, 'domain' from nation union all select 'process:' || o_orderkey, o_orderkey::varchar, 'process' from orders union all select 'service:' || s_suppkey, s_name, 'service' from supplier),
edges as (select 'user:' || c_custkey as source, 'domain:' || c_nationkey as target, 'lives' as rel from customer union all select 'user:' || o_custkey, 'process:' || o_orderkey, 'ran' from orders union all select 'service:' || s_suppkey, 'domain:' || s_nationkey, 'located' from supplier),
degrees as (select id, count(*) as degree from (select source as id from edges union all select target from edges) group by id),
kept as (select n.*, coalesce(degree, 0)::bigint as degree, ((case when type in ('user', 'ip', 'domain') then 500 else 0 end) + coalesce(degree, 0))::bigint as priority from nodes n left join degrees d on n.id = d.id order by priority desc, n.id limit 150)"""


@query(f"with {_GRAPH_SQL} select * from nodes")
def q_graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0]


@query(f"with {_GRAPH_SQL} select * from edges")
def q_graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query(f"with {_GRAPH_SQL} select id, label, type, degree, priority from kept")
def q_graph_trim(spark, sf_dir):
    kept, _ = G.trim(*_graph(spark, sf_dir))
    return kept.select("id", "label", "type", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.col("priority").cast("long").alias("priority"))


@query(f"with {_GRAPH_SQL} select e.* from edges e where source in (select id from kept) and target in (select id from kept)")
def q_graph_trim_edges(spark, sf_dir):
    return G.trim(*_graph(spark, sf_dir))[1]


@query("""with recursive e as (select event_id, ts::date as day, user_id::varchar as u, json_extract_string(props, '$.k') as k from events where event_type = 'error'),
link as (select a.event_id as a, b.event_id as b from e a join e b on a.day = b.day and (a.u = b.u or a.k = b.k)), reach as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a)
select a as event_id, min(b) as component from reach group by a""")
def q_risk_components(spark, sf_dir):
    rows = _events(spark, sf_dir).filter("event_type = 'error'").select("event_id", F.to_date("ts").alias("day"), "user_id", SOURCE(F.col("props")).alias("k"))
    return G.components_by_keys(rows, "event_id", ["user_id", "k"], ["day"])


@query("select d.doc_id, case when toxic = 1 then 'true_positive' when quality = 0 then 'false_positive' when quality = 1 then 'benign' end as verdict from documents d left join labels l on d.doc_id = l.doc_id")
def q_triage_join(spark, sf_dir):
    return T.with_triage(table(spark, sf_dir, "documents").select("doc_id"), _triage(spark, sf_dir), "doc_id").select("doc_id", "verdict")


def _triage(spark, sf_dir):
    verdict = F.when(F.col("toxic") == 1, "true_positive").when(F.col("quality") == 0, "false_positive").when(F.col("quality") == 1, "benign")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("finding_id"), verdict.alias("verdict"), F.lit("").alias("note"))


@query("select coalesce(case when toxic = 1 then 'true_positive' when quality = 0 then 'false_positive' when quality = 1 then 'benign' end, 'untriaged') as status, count(*)::bigint as n from documents d left join labels l on d.doc_id = l.doc_id group by 1")
def q_triage_counts(spark, sf_dir):
    return T.triage_counts(T.with_triage(table(spark, sf_dir, "documents").select("doc_id"), _triage(spark, sf_dir), "doc_id"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 0 and quality = 0)")
def q_fp_anti(spark, sf_dir):
    return T.without_false_positives(table(spark, sf_dir, "documents").select("doc_id"), _triage(spark, sf_dir), "doc_id")


@query("select o_custkey, arg_max(o_orderstatus, o_orderkey) as status, max(o_orderkey) as updated_at, min(o_orderdate) as created_at from orders group by o_custkey")
def q_incident_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("updated_at"), F.col("o_orderdate").alias("created_at"))
    return T.upsert(rows.filter("status = 'F'"), rows.filter("status <> 'F'"), "o_custkey", created="created_at")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def q_incident_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return T.delete(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey").select("o_orderkey")


@query("""select o_orderkey, max(case when o_orderkey % 10 = 3 then 'changed' else o_orderstatus end) as status, max(case when o_orderkey % 10 = 3 then 1 else 0 end)::int as updated_at from orders
where o_orderkey not in (select o_orderkey from orders where o_custkey % 7 = 0 and o_orderkey % 10 <> 3) group by 1""")
def q_store_changes(spark, sf_dir):
    """Orders kept in a store by key; those of some customers are deleted, others changed, of which some come back."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.lit(0).alias("updated_at"))
    store = KeyedStore.create(spark, f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}", orders.drop("o_custkey"), "o_orderkey", 16)
    store.delete(orders.filter("o_custkey % 7 = 0").select("o_orderkey"))
    store.upsert(orders.filter("o_orderkey % 10 = 3").select("o_orderkey", F.lit("changed").alias("status"), F.lit(1).alias("updated_at")))
    store.forget()
    return store.read()


# Retrieval


@query("""with q as (select embedding as qe from embeddings order by vec_id limit 1) select vec_id, round(list_cosine_similarity(embedding::double[], qe::double[]), 3) as score from embeddings, q where round(list_cosine_similarity(embedding::double[], qe::double[]), 3) >= 0.1 order by score desc, vec_id limit 15""")
def q_cosine_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    first = [float(x) for x in rows.orderBy("vec_id").first()["embedding"]]
    return R.nearest(rows, "embedding", first, 15, "vec_id").select("vec_id", "score")


@query("""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) as term from documents), c as (select doc_id, term, count(*) as n from t group by 1, 2), l as (select doc_id, sqrt(sum(n * n)) as norm from c group by 1)
select doc_id, round(sum(n / norm * 0.5), 3) as score from c join l using (doc_id) where term in ('worthless', 'password', 'the', 'that') group by doc_id having round(sum(n / norm * 0.5), 3) >= 0.1 order by score desc, doc_id limit 15""")
def q_keyword_topk(spark, sf_dir):
    return R.keyword_search(R.keyword_index(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "worthless password, the that", 15)


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" union all ".join(f"select '{t}' as artifact, count(*)::bigint as n from {t}" for t in _TABLES))
def q_coverage(spark, sf_dir):
    return fi.union(*[table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("artifact"), "n") for t in _TABLES])


@query("select event_id, ts from events")
def q_parse_time(spark, sf_dir):
    """Times written with an offset of two hours come back in UTC."""
    written = F.concat(F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    return _events(spark, sf_dir).select("event_id", S.parse_time(written).alias("ts"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brute-force findings: accounts with five failures or more, in report order."""
    n = A.over_threshold(_events(spark, sf_dir).filter("event_type = 'error'"), ["user_id"], 5)
    rows = n.withColumns({"artifact": F.lit("events"), "host": F.col("user_id").cast("string"), "row_index": F.lit(None).cast("long")})
    found = fi.emit(rows, "credential_access", "high", F.concat(F.lit("Possible brute force on account "), F.col("user_id").cast("string")), F.concat(F.col("n").cast("string"), F.lit(" failed attempts")), 65, "T1110", {"attempts": F.col("n")})
    return fi.in_order(fi.identity(found))


from tracehound.plans import case_queries, detector_queries, hunt_queries, report_queries  # noqa: E402

QUERIES |= detector_queries.QUERIES | case_queries.QUERIES | report_queries.QUERIES | hunt_queries.QUERIES
ORACLES |= detector_queries.ORACLES | case_queries.ORACLES | report_queries.ORACLES | hunt_queries.ORACLES
