"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .fingerprints import canonical_text, numbered, wide_hash, with_next
from .line_dedup import dedup_lines
from .minhash import near_duplicates
from .mixing import mix_sources
from .neighbours import search
from .periodic_runs import fold, periodic_runs, strongest
from .quality import FIRST_ACCURACY, FIRST_SHARE, FIRST_WEIGHT, LEAST_ACCURACY, MOST_ACCURACY, ROUNDS, RULES, score_quality
from .shared import spread, staged, table, text_or_empty
from .sharding import shard_documents
from .token_counts import count_documents
from .toxicity import held_out, score_documents
from .transducer import encode_digests
from .url_filters import match_urls

#: host, path, verdict
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _sha256(column) -> F.Column:
    return F.sha2(F.encode(column, "UTF-8"), 256)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))

    def hashed(df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("canonical", canonical_text(F.col(text))).withColumns({"fingerprint": wide_hash(F.col("canonical")), "check": F.sha2("canonical", 256)})

    def edited(df: DataFrame) -> DataFrame:
        n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
        return df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))

    own = hashed(docs, "text").drop("canonical")
    rows = edited(with_next(own, ("text", "fingerprint", "check"))).withColumnsRenamed({"fingerprint": "own_fingerprint", "check": "own_check"})
    rows = hashed(rows, "edited").withColumnsRenamed({"fingerprint": "edited_fingerprint", "check": "edited_check", "own_fingerprint": "fingerprint", "own_check": "check"})
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), _sha256("edited").alias("edited_sha256"), "fingerprint", "check", "edited_fingerprint", "edited_check", "next_fingerprint", "next_check")
    rows = staged(rows, "op1-hashed")
    # The texts behind the fingerprints, made again for the buckets that several rows share.
    buckets = [rows.select("fingerprint"), rows.select(F.col("edited_fingerprint").alias("fingerprint"))]
    texts = [hashed(docs, "text"), hashed(edited(with_next(docs, ("text",))), "edited")]
    rows = numbered(rows, texts, {"fingerprint": "check", "edited_fingerprint": "edited_check", "next_fingerprint": "next_check"}, buckets)
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), _sha256(text_or_empty()).alias("text_sha256"))


OP2_SQL = """
with lines as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as line
  from documents),
windows as (
  select doc_id, pos, trim(line) || chr(10) || trim(lead(line, 1) over w) || chr(10) || trim(lead(line, 2) over w) as three
  from lines window w as (partition by doc_id order by pos)),
ranked as (
  select *, first_value(doc_id) over w as first_doc, first_value(pos) over w as first_pos, row_number() over w as nth
  from windows where three is not null and three <> chr(10) || chr(10)
  window w as (partition by three order by doc_id, pos rows between unbounded preceding and unbounded following)),
covered as (
  select distinct doc_id, pos + unnest([0, 1, 2]) as line, doc_id = first_doc as own, first_pos from ranked where nth > 1),
removed as (select distinct doc_id, line as pos from covered where not own or line >= first_pos + 3)
select l.doc_id, count(*)::bigint as n_lines, count(r.pos)::bigint as n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) order by l.pos) filter (r.pos is null), '')) as text_sha256
from lines l left join removed r on l.doc_id = r.doc_id and l.pos = r.pos
group by l.doc_id
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


OP5_SQL = """
with parts as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules(r_host, r_path, r_verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
hits as (
  select page_id, arg_max(r_host || r_path, length(r_host || r_path)) as rule, arg_max(r_verdict, length(r_host || r_path)) as verdict
  from parts join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path) group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts p left join hits h on p.page_id = h.page_id
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op11_rounds() -> str:
    """The rounds of expectation-maximisation, each a step over (pattern, rule, vote) rows."""
    steps = [f"rules0 as materialized (select i as rule, {FIRST_ACCURACY}::double as accuracy, {FIRST_SHARE}::double as share from range({len(RULES)}) t(i))"]
    for i in range(ROUNDS + 1):
        steps.append(f"""scored{i} as materialized (
  select pattern, any_value(v.n) as n, 1 / (1 + exp(-(ln(any_value(share) / (1 - any_value(share))) + sum([0, 1, -1][vote + 1] * ln(accuracy / (1 - accuracy)))))) as q
  from votes v join rules{i} r on v.rule = r.rule group by pattern)""")
        if i < ROUNDS:
            steps.append(f"""rules{i + 1} as materialized (
  select v.rule, least(greatest((sum(s.n * case vote when 1 then q when 2 then 1 - q else 0 end) + {FIRST_WEIGHT * FIRST_ACCURACY}) / (sum(case when vote > 0 then s.n else 0 end) + {FIRST_WEIGHT}), {LEAST_ACCURACY}), {MOST_ACCURACY}) as accuracy,
    (sum(s.n * q) + {FIRST_WEIGHT * FIRST_SHARE}) / (sum(s.n) + {FIRST_WEIGHT}) as share
  from votes v join scored{i} s on v.pattern = s.pattern group by v.rule)""")
    return ",\n".join(steps)


_OP11_VOTES = ", ".join(f"case when {bad} then 2 when {good} then 1 else 0 end" for _, good, bad in RULES)
OP11_SQL = rf"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
split as (
  select doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) as lines from texts),
placed as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from split),
grams as (
  select doc_id, pos, word || ' ' || lead(word, 1) over w || ' ' || lead(word, 2) over w || ' ' || lead(word, 3) over w || ' ' || lead(word, 4) over w as gram
  from placed window w as (partition by doc_id order by pos)),
twice as (select doc_id, pos from grams where gram is not null qualify count(*) over (partition by doc_id, gram) > 1),
covered as (select doc_id, count(distinct pos + k) as n from twice, range(5) t(k) group by doc_id),
features as (
  select s.doc_id, len(words)::bigint as n_words, length(list_aggregate(words || [''], 'string_agg', ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_capitals, (length(text) - length(replace(text, '!', '')))::bigint as n_shouts,
    (length(text) - length(regexp_replace(text, '[!-/:-@\\[-`{{-~]', '', 'g')))::bigint as n_marks, len(list_filter(words, lambda w: right(w, 1) in ('.', '!', '?')))::bigint as n_ends,
    len(list_filter(words, lambda w: length(w) <= 3 and not regexp_matches(w, '[#*$%&|<>]')))::bigint as n_small_words, len(list_distinct(words))::bigint as n_distinct
  from split s left join covered c on s.doc_id = c.doc_id),
coded as materialized (select *, [{_OP11_VOTES}] as pattern from features),
patterns as (select pattern, count(*)::double as n from coded group by pattern),
votes as materialized (select pattern, n, generate_subscripts(pattern, 1) - 1 as rule, unnest(pattern) as vote from patterns),
{_op11_rounds()}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and q >= 0.5 as kept
from coded join scored{ROUNDS} s on coded.pattern = s.pattern
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
with pieces as (
  select doc_id, coalesce(lang, 'und') as lang, generate_subscripts(p, 1) as piece, unnest(p) as piece_text
  from (select doc_id, lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') as p from documents)),
split as (select doc_id, lang, piece, list_filter(string_split_regex(piece_text, '[\\x20\\x09]+'), lambda w: w <> '') as words from pieces),
placed as (select doc_id, lang, piece, unnest(words) as w1, generate_subscripts(words, 1) as pos from split),
triples as (select lang, w1, lead(w1, 1) over o as w2, lead(w1, 2) over o as w3 from placed window o as (partition by doc_id, piece order by pos)),
one as (select lang, w1, count(*) as f from triples group by all),
two as (select lang, w1, w2, count(*) as f from triples where w2 is not null group by all),
three as (select lang, w1, w2, w3, count(*) as f from triples where w3 is not null group by all having count(*) >= 10),
totals as (select lang, sum(f)::bigint as n from one group by lang),
cuts as (
  select t.lang, t.w1 || ' ' || t.w2 as phrase, t.f as a, x.f as l, y.f as r, 1 as k
  from two t join one x on t.lang = x.lang and t.w1 = x.w1 join one y on t.lang = y.lang and t.w2 = y.w1
  where t.f >= 10 and not exists (
    select 1 from three h where h.lang = t.lang and (h.w1 = t.w1 and h.w2 = t.w2 or h.w2 = t.w1 and h.w3 = t.w2) and 100 * h.f >= 50 * t.f)
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 1
  from three t join one x on t.lang = x.lang and t.w1 = x.w1 join two y on t.lang = y.lang and t.w2 = y.w1 and t.w3 = y.w2
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 2
  from three t join two x on t.lang = x.lang and t.w1 = x.w1 and t.w2 = x.w2 join one y on t.lang = y.lang and t.w3 = y.w1),
scored as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cuts),
chosen as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from chosen)
select r.lang, rank, phrase, a, l, r, n, score from ranked r join totals t on r.lang = t.lang where rank <= 2000
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(fold(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    milli = F.expr("1000 * best.length div best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        _sha256(listed).alias("runs_sha256"), _sha256("collapsed").alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_line_dedup": op2_line_dedup,
    "op3_sharding": op3_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_url_filters": op5_url_filters,
    "op6_token_counts": op6_token_counts,
    "op7_neighbours": op7_neighbours,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_near_dedup": op9_near_dedup,
    "op10_mixing": op10_mixing,
    "op11_quality_rules": op11_quality_rules,
    "op12_collocations": op12_collocations,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op5_url_filters": OP5_SQL, "op11_quality_rules": OP11_SQL, "op12_collocations": OP12_SQL}
