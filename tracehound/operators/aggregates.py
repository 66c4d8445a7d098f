"""Grouped detectors and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.functions.scalars import severity_name, severity_rank
from tracehound.functions.tables import TACTIC_ORDER, TECHNIQUE_TACTICS


def over_threshold(rows: DataFrame, keys: list[str], least: int, samples: Column | None = None, order: str | None = None, n_samples: int = 5) -> DataFrame:
    """Groups with at least `least` rows: keys, n, and the first few samples by order, if asked for."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    if samples is None:
        return counts
    first = Window.partitionBy(*keys).orderBy(order)
    few = rows.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= n_samples)
    few = few.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", samples.alias("s")))), lambda x: x["s"]).alias("samples"))
    return counts.join(few, keys)


def top_then_least(rows: DataFrame, key: str, top: int, least: int) -> DataFrame:
    """Of the `top` most frequent keys (ties: smaller key) those with at least `least` rows."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), key).limit(top).filter(F.col("n") >= least)


def many_values(rows: DataFrame, key: str, value: str, least: int, show: int = 5) -> DataFrame:
    """Keys with at least `least` distinct values, and the first of these."""
    pairs = rows.filter(F.col(value).isNotNull()).select(key, value).distinct()
    few = Window.partitionBy(key).orderBy(value)
    shown = pairs.withColumn("__n", F.row_number().over(few)).filter(F.col("__n") <= show).groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("shown"))
    return pairs.groupBy(key).agg(F.count("*").alias("n_values")).filter(F.col("n_values") >= least).join(shown, key)


def distribution(rows: DataFrame, key: str, top: int = 20) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(top)


def stack_counts(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, value, n) over all dimensions in one pass."""
    parts = F.array(*[F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value")) for d, v in dimensions.items()])
    return rows.select(F.explode(parts).alias("p")).select("p.*").filter(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def stack_samples(rows: DataFrame, dimensions: dict[str, Column], order: str, n_samples: int = 5) -> DataFrame:
    """(dimension, value, n, samples): stack counts with the `order` values of the first rows of each value."""
    parts = F.array(*[F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value")) for d, v in dimensions.items()])
    held = rows.select(F.col(order).alias("at"), F.explode(parts).alias("p")).select("p.*", "at").filter(F.col("value").isNotNull() & (F.col("value") != ""))
    first = held.withColumn("__n", F.row_number().over(Window.partitionBy("dimension", "value").orderBy("at"))).filter(F.col("__n") <= n_samples)
    few = first.groupBy("dimension", "value").agg(F.sort_array(F.collect_list("at")).alias("samples"))
    return held.groupBy("dimension", "value").agg(F.count("*").alias("n")).join(few, ["dimension", "value"])


def top_techniques(findings: DataFrame, top: int = 15) -> DataFrame:
    """(mitre, n) of the most frequent techniques."""
    return top_then_least(findings.filter(F.coalesce("mitre", F.lit("")) != ""), "mitre", top, 1)


def technique_titles(findings: DataFrame, most: int = 3) -> DataFrame:
    """(mitre, titles): the first distinct titles of each technique by alphabet."""
    titles = findings.select("mitre", "title").distinct().withColumn("__n", F.row_number().over(Window.partitionBy("mitre").orderBy("title")))
    return titles.filter(F.col("__n") <= most).groupBy("mitre").agg(F.sort_array(F.collect_list("title")).alias("titles"))


def rare(counts: DataFrame, n: int = 1) -> DataFrame:
    return counts.filter(F.col("n") <= n)


def differing(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n_values")).filter(F.col("n_values") > 1)


#: Categories that together make a chain, and the chain's name.
CHAINS = (
    (("execution", "persistence"), "execution and persistence"),
    (("credential_access", "privilege_escalation"), "credential access and privilege escalation"),
    (("credential_access", "lateral_movement"), "credential access and lateral movement"),
    (("defense_evasion",), "defense evasion"),
    (("network_anomaly", "execution"), "execution and network anomaly"),
    (("lateral_movement",), "lateral movement"),
    (("exfiltration",), "exfiltration"),
)
KILL_CHAIN = ("execution", "persistence", "privilege_escalation", "defense_evasion", "credential_access", "lateral_movement")


def chains(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Chains of categories that are all present, the kill-chain stages, and whether ransomware shows; for all
    findings or for each group of keys."""
    present = lambda c: F.coalesce(F.bool_or(F.col("category") == c), F.lit(False))
    flags = [present(c).alias(f"has_{c}") for c in dict.fromkeys([*KILL_CHAIN, "network_anomaly", "exfiltration"])]
    extra = [F.count_if(F.col("category") == "correlated_risk").alias("n_risk"), F.coalesce(F.bool_or(F.lower("title").rlike("shadow|ransomware")), F.lit(False)).alias("ransomware")]
    one = findings.groupBy(*(keys or [])).agg(*flags, *extra)
    named = F.array_compact(F.array(*[F.when(F.forall(F.array(*[F.col(f"has_{c}") for c in cs]), lambda x: x), F.lit(name)) for cs, name in CHAINS]))
    stages = sum((F.col(f"has_{c}").cast("int") for c in KILL_CHAIN), F.lit(0))
    return one.select(*(keys or []), named.alias("chains"), stages.alias("n_stages"), (stages >= 4).alias("full_chain"), "n_risk", "ransomware")


def with_tactic(findings: DataFrame, technique: str = "mitre") -> DataFrame:
    """findings with the technique's tactic: Uncategorized without technique, Other for an unknown one."""
    spark = findings.sparkSession
    tactics = spark.createDataFrame(sorted(TECHNIQUE_TACTICS.items()), "__t string, tactic string")
    base = F.substring_index(technique, ".", 1)
    joined = findings.withColumn("__b", base).join(F.broadcast(tactics), F.col("__b") == F.col("__t"), "left").drop("__b", "__t")
    return joined.withColumn("tactic", F.when(F.coalesce(F.col(technique), F.lit("")) == "", "Uncategorized").otherwise(F.coalesce("tactic", F.lit("Other"))))


def technique_coverage(findings: DataFrame) -> DataFrame:
    """(tactic, mitre, n, max_severity, tactic_total) in kill-chain order of tactics by tactic_order."""
    counted = with_tactic(findings).groupBy("tactic", "mitre").agg(F.count("*").alias("n"), severity_name(F.min(severity_rank(F.col("severity")))).alias("max_severity"))
    totals = F.sum("n").over(Window.partitionBy("tactic"))
    order = F.array_position(F.array(*map(F.lit, TACTIC_ORDER)), F.col("tactic")).cast("int")
    return counted.select("tactic", "mitre", "n", "max_severity", totals.alias("tactic_total"), F.when(order > 0, order).otherwise(99).alias("tactic_order"))
