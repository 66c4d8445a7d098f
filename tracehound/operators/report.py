"""Sections of a report as tables, text for findings, related findings and batches of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.scalars import parent_folder, severity_name, severity_rank, tool_token
from tracehound.sources.staging import staged

from .aggregates import technique_coverage, with_tactic
from .graph import components_by_keys
from .slices import SLICE, numbered, packed, running, sliced

#: The parts of categories, of which the first hit counts, in their order. What they mean is our wording.
MEANINGS = (
    ("malware_signature", "Known bytes were found inside the file, whatever its name or place."), ("malware", "Protection software or a rule named a threat; a hash or a sandbox may clear it."), ("hash_reputation", "The file's hash is on a list of known bad files, which is as good as the list is new."),
    ("correlated_risk", "Several kinds of evidence meet at one entity."), ("process_anomaly", "A process ran in an unusual way: its place, its parent or its arguments."), ("process_name", "A process has a name that is watched; it may belong here."),
    ("persistence", "Something arranged to be started again; see who made it and when."), ("credential_access", "Someone may be taking or guessing credentials."), ("defense_evasion", "Something hid itself or switched protection off."), ("network_anomaly", "A connection or its other end is unusual."),
    ("network", "A connection was flagged; look at the process that opened it."), ("execution_evidence", "A trace shows that a program ran here, even if it is gone."), ("execution", "Something was run; what it was and whether it belongs here counts."), ("discovery", "Something looked around: files, processes or users."),
    ("sigma_detection", "An event rule matched; the raw event tells whether it holds."), ("suspicious_file", "A file lies where programs seldom do."), ("suspicious", "A rule of thumb flagged this."), ("anomaly", "This is rare on this host."),
    ("yara", "Known bytes were found inside the file, whatever its name or place."),
)
DEFAULT_MEANING = "A detector flagged this; the evidence tells more."
EVIDENCE_ORDER = ("path", "name", "process", "pid", "cmdline", "remote", "domain", "key", "value", "row_index")


def meaning(category: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(F.lower(category), F.lit(p)), m) for p, m in MEANINGS], F.lit(DEFAULT_MEANING))


def evidence_fields(evidence: Column) -> Column:
    """array<struct<order, label, value, long>> in reading order; known fields first, then others by name."""
    place = lambda k: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, EVIDENCE_ORDER)), k), F.lit(0)), F.lit(99))
    entries = F.transform(F.map_entries(evidence), lambda e: F.struct(place(e["key"]).alias("order"), F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))).alias("label"), e["value"].alias("value"), ((F.char_length(e["value"]) > 120) | (place(e["key"]) == 99)).alias("long")))
    return F.array_sort(entries)


def metrics(findings: DataFrame) -> DataFrame:
    """One row: findings, occurrences, severities, techniques and tactics."""
    n = F.sum(F.coalesce("occurrences", F.lit(1))) if "occurrences" in findings.columns else F.count("*")
    return with_tactic(findings).agg(F.count("*").alias("findings"), n.alias("occurrences"), *[F.count_if(F.lower("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")], F.count_distinct(F.nullif("mitre", F.lit(""))).alias("techniques"), F.count_distinct("tactic").alias("tactics"))


def bottom_line(m: DataFrame) -> DataFrame:
    text = F.when(F.col("critical") > 0, F.concat(F.lit("Act now: "), F.col("critical").cast("string"), F.lit(" critical findings."))).when(F.col("high") >= 3, "Likely incident: several findings of high severity.").when(F.col("high") > 0, "Look into the findings of high severity.").when(F.col("findings") > 0, "Only minor findings.").otherwise("No findings.")
    return m.withColumn("bottom_line", text)


def incident_severity(base: Column, critical: Column, high: Column) -> Column:
    """A critical finding makes the incident critical, three high ones high, one lifts low and info to medium."""
    return F.when(critical > 0, "critical").when((high >= 3) & ~base.isin("critical"), "high").when((high >= 1) & base.isin("low", "info"), "medium").otherwise(base)


def ordered_iocs(iocs: DataFrame) -> DataFrame:
    """Indicators as a report has them: the surest first, of these the malicious."""
    return iocs.orderBy(F.desc("confidence"), F.desc("malicious"), "value")


def ordered_techniques(techniques: DataFrame) -> DataFrame:
    return techniques.orderBy(F.desc("confidence"), "technique")


def gap_status(gaps: DataFrame) -> DataFrame:
    """(question, category, priority, status, answer) of gaps(…, cloud_answer, local_answer): by whom a question was answered."""
    held = lambda c: F.nullif(F.trim(c), F.lit(""))
    status = F.when(held("cloud_answer").isNotNull(), "resolved_cloud").when(held("local_answer").isNotNull(), "resolved_local").otherwise("pending")
    return gaps.select("question", "category", "priority", status.alias("status"), F.coalesce(held("cloud_answer"), held("local_answer"), F.lit("")).alias("answer"))


def statistics(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """(name, n): findings by severity as <severity>_detections, and rows by artifact as <artifact>_total_rows."""
    by_severity = findings.groupBy(F.concat(F.lower("severity"), F.lit("_detections")).alias("name")).agg(F.count("*").alias("n"))
    return by_severity.unionByName(rows.groupBy(F.concat("artifact", F.lit("_total_rows")).alias("name")).agg(F.count("*").alias("n")))


def merge_new(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """known, and the first row of each key of new that known lacks."""
    return known.unionByName(new.dropDuplicates([key]).join(known.select(key), key, "left_anti"), allowMissingColumns=True)


def executive_metrics(findings: DataFrame, iocs: DataFrame, chains: DataFrame) -> DataFrame:
    """metrics() with the numbers of indicators, malicious ones among them, and of chains that show."""
    one = metrics(findings)
    seen = iocs.agg(F.count("*").alias("iocs"), F.count_if("malicious").alias("malicious_iocs"))
    return one.crossJoin(seen).crossJoin(chains.agg(F.coalesce(F.sum(F.size("chains")), F.lit(0)).alias("chains")))  # One row each.


def in_scope(findings: DataFrame, severities: tuple[str, ...]) -> DataFrame:
    """The findings of these severities; all of them if there is none."""
    hit = F.lower("severity").isin(*severities)
    some = findings.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("__some"))  # One row.
    return findings.crossJoin(F.broadcast(some)).filter(hit | ~F.col("__some")).drop("__some")


def with_status(findings: DataFrame, triage: DataFrame, statuses: tuple[str, ...] = (), default: str = "new") -> DataFrame:
    """findings(id, ...) with the status of triage(id, status), `default` where there is none, of these statuses only if any
    are given."""
    out = findings.join(triage.select("id", "status"), "id", "left").withColumn("status", F.coalesce("status", F.lit(default)))
    return out.filter(F.col("status").isin(*statuses)) if statuses else out


def matching(findings: DataFrame, severity: str | None = None, needle: str = "") -> DataFrame:
    """The findings of a severity that hold a text in title, description, category, technique or artifact."""
    out = findings if severity is None else findings.filter(F.lower("severity") == severity.lower())
    text = F.lower(F.concat_ws(" ", "title", "description", "category", "mitre", "artifact"))
    return out.filter(F.contains(text, F.lit(needle.lower())))


def clusters_of_batches(clusters: DataFrame, batch_ids: DataFrame) -> DataFrame:
    """(batch, cluster) where a cluster(cluster, ids) has a finding of a batch(id, batch); joined by id, each pair once."""
    return clusters.select("cluster", F.explode("ids").alias("id")).join(batch_ids, "id").select("batch", "cluster").distinct()


def count_by_category(mapping: DataFrame) -> DataFrame:
    """(category, n) of a redaction mapping."""
    return mapping.groupBy("category").agg(F.count("*").alias("n"))


#: Rows of a case that its report shows; everything is kept beside them.
SHOWN = {"findings": 2000, "timeline": 200, "clusters": 20, "chains": 30}


def persist_case(tables: dict[str, DataFrame], orders: dict[str, list], path: str) -> DataFrame:
    """Writes each table whole, and beside it the first rows by its order that the report shows. (name, total, shown)."""
    spark, out = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        kept = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        kept.orderBy(*orders[name]).limit(SHOWN.get(name, 2000)).write.mode("overwrite").parquet(f"{path}/{name}_shown")
        total = kept.count()
        out.append((name, total, min(total, SHOWN.get(name, 2000))))
    return spark.createDataFrame(out, "name string, total long, shown long")


def sections(findings: DataFrame, coverage: DataFrame, parts: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of a report by name. Of parts those that are there become sections: iocs, techniques (that analysts name), timeline, gaps,
    mapping (of a redaction), triage and rows (of the collection)."""
    parts = parts or {}
    out = {"metrics": bottom_line(metrics(findings)), "coverage": coverage, "techniques": technique_coverage(findings), "findings": findings.withColumn("why", meaning(F.col("category")))}
    make = {
        "iocs": lambda x: ordered_iocs(x), "techniques": lambda x: ordered_techniques(x), "timeline": lambda x: x.orderBy("timestamp"), "gaps": gap_status, "mapping": count_by_category,
        "triage": lambda x: findings.join(x.select("id", "verdict"), "id").groupBy("verdict").agg(F.count("*").alias("n")), "rows": lambda x: statistics(findings, x),
    }
    named = {"techniques": "mitre_techniques", "gaps": "knowledge_gaps", "mapping": "anonymization", "triage": "finding_triage", "rows": "detection_statistics"}
    return out | {named.get(k, k): make[k](df) for k, df in parts.items()}


def write_sections(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def folder_clusters(findings: DataFrame, least: int = 2) -> DataFrame:
    """(folder, ids, n) of findings in one folder whose name has 15 characters or more."""
    rows = findings.withColumn("folder", parent_folder(F.col("evidence")["path"])).filter(F.char_length("folder") >= 15)
    return rows.groupBy("folder").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.count("*").alias("n")).filter(F.col("n") >= least)


def tool_clusters(findings: DataFrame, grouped: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(token, ids, n) of findings that name one tool, unless all of them are grouped already."""
    rows = findings.withColumn("token", tool_token(F.col("evidence")["path"])).filter("token is not null")
    if grouped is not None:
        ids = grouped.select(F.explode("ids").alias("id")).distinct().withColumn("known", F.lit(True))
        rows = rows.join(ids, "id", "left")
    else:
        rows = rows.withColumn("known", F.lit(False))
    out = rows.groupBy("token").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.count("*").alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"))
    return out.filter((F.col("n") >= least) & ~F.col("all_known")).drop("all_known").orderBy(F.desc("n"), "token")


def batches(findings: DataFrame, size: int) -> DataFrame:
    """(id, batch): related findings (same folder, tool, technique or process) in one batch, at most `size` in each.

    Components are packed greedily, worst severity and largest first. A component larger than a batch is cut, in order
    of id. Neither a component nor the list of them is in one task.
    """
    keyed = findings.withColumns({"folder": F.when(F.char_length(parent_folder(F.col("evidence")["path"])) >= 15, parent_folder(F.col("evidence")["path"])), "token": tool_token(F.col("evidence")["path"]), "technique": F.nullif("mitre", F.lit("")), "process": F.nullif(F.col("evidence")["pid"], F.lit(""))})
    placed = components_by_keys(keyed, "id", ["folder", "token", "technique", "process"]).join(findings.select("id", severity_rank(F.col("severity")).alias("rank")), "id")
    placed = running(sliced(placed, ["component"], ["id"], "batches-members"), ["component"], ["id"], {"nth": ("sum", F.lit(1).cast("long"))}).drop(SLICE)
    placed = staged(placed.withColumn("part", F.floor((F.col("nth") - 1) / size)), "batches-parts")
    parts = placed.groupBy("component", "part").agg(F.count("*").alias("n"), F.min("rank").alias("rank")).withColumn("least", -F.col("n"))
    batch = packed(parts, ["rank", "least", "component", "part"], "n", size, "batch", "batches")
    return placed.join(batch.select("component", "part", "batch"), ["component", "part"]).select("id", F.col("batch").cast("int").alias("batch"))


def summary_lines(findings: DataFrame, most: int | None = 200) -> DataFrame:
    """(n, line): the worst findings as numbered lines of text; all of them if most is None."""
    order = {"__rank": severity_rank(F.col("severity")), "__score": -F.col("score")}
    top = findings.withColumns(order)
    top = top if most is None else top.orderBy("__rank", "__score", "title", "id").limit(most)
    line = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("title"), F.lit(" - "), F.col("description"))
    return numbered(top.select(*order.values(), "title", "id", line.alias("line")).toDF("__rank", "__score", "title", "id", "line"), ["__rank", "__score", "title", "id"], "n", "summary-lines").select("n", "line")


def cluster_lines(clusters: DataFrame, most: int | None = 15) -> DataFrame:
    """(folder, line) of the largest clusters(folder, ids, n): how many findings share a folder, and which."""
    line = F.concat(F.col("n").cast("string"), F.lit(" findings in "), F.col("folder"), F.lit(": "), F.array_join("ids", ", "))
    out = clusters.select("folder", "n", line.alias("line"))
    return (out if most is None else out.orderBy(F.desc("n"), "folder").limit(most)).select("folder", "line")


def worst(severity: Column) -> Column:
    return severity_name(F.min(severity_rank(severity)))
