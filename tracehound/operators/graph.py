"""Entity graph: nodes, edges, degrees, trimming, components and risk by component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.scalars import severity_name, severity_rank
from tracehound.sources.staging import staged

from .components import connected_components


def node(kind: str, key: Column, label: Column | None = None) -> Column:
    return F.struct(F.concat(F.lit(f"{kind}:"), key.cast("string")).alias("id"), (label if label is not None else key).cast("string").alias("label"), F.lit(kind).alias("type"))


def nodes_of(*parts: DataFrame) -> DataFrame:
    """Distinct nodes by id of tables with a node column; the least label wins."""
    out = parts[0].select("node.*")
    for p in parts[1:]:
        out = out.unionByName(p.select("node.*"))
    return out.groupBy("id").agg(F.min("label").alias("label"), F.min("type").alias("type"))


def edges_of(*parts: DataFrame) -> DataFrame:
    """(source, target, rel) of all parts; repeated edges stay."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("source", "target", "rel")


def with_findings(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """nodes with finding_count and max_severity from hits(id, severity)."""
    agg = hits.groupBy("id").agg(F.count("*").alias("finding_count"), severity_name(F.min(severity_rank(F.col("severity")))).alias("max_severity"))
    return nodes.join(agg, "id", "left").withColumn("finding_count", F.coalesce("finding_count", F.lit(0)))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def trim(nodes: DataFrame, edges: DataFrame, most: int = 150, entity_types: tuple[str, ...] = ("user", "ip", "domain")) -> tuple[DataFrame, DataFrame]:
    """The `most` nodes of highest priority (findings, then entity types, then degree; ties by id) and the edges among
    them. What is kept is bounded by `most`, so it is sent to every task."""
    has = F.coalesce(F.col("finding_count"), F.lit(0)) > 0 if "finding_count" in nodes.columns else F.lit(False)
    priority = F.when(has, 1000).otherwise(0) + F.when(F.col("type").isin(*entity_types), 500).otherwise(0) + F.coalesce("degree", F.lit(0))
    kept = nodes.join(degrees(edges), "id", "left").withColumn("priority", priority).orderBy(F.desc("priority"), "id").limit(most)
    ids = F.broadcast(kept.select(F.col("id").alias("__id")))
    inside = edges.join(ids, edges["source"] == F.col("__id"), "left_semi")
    return kept, inside.join(ids, inside["target"] == F.col("__id"), "left_semi")


def components_by_keys(rows: DataFrame, item: str, keys: list[str], scope: list[str] | None = None) -> DataFrame:
    """(item, component): items that share a value of any key are in one component, named by its least item.

    Items are tied to the least item of each value, not to one another, so a value that many items share costs one
    edge an item.
    """
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys])
    pairs = staged(rows.select(item, *(scope or []), F.explode(parts).alias("p")).select(item, *(scope or []), "p.*").filter(F.col("v").isNotNull() & (F.col("v") != "")), "component-keys")
    least = staged(pairs.groupBy(*(scope or []), "k", "v").agg(F.min(item).alias("__least")), "component-least")
    edges = pairs.join(least, [*(scope or []), "k", "v"]).select(F.col(item).alias("a"), F.col("__least").alias("b"))
    found = connected_components(edges)
    return rows.select(item).distinct().join(found, F.col(item) == F.col("node"), "left").select(item, F.coalesce("component", item).alias("component"))


def entity_risk(findings: DataFrame, item: str, keys: list[str], least_categories: int = 2, least_score: int = 130, scope: list[str] | None = None) -> DataFrame:
    """Components of findings with enough categories and score: (component, n, categories, total, severity, score)."""
    placed = findings.join(components_by_keys(findings, item, keys, scope), item)
    summed = placed.groupBy("component").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("category")).alias("categories"), F.sum("score").alias("total"),
        F.min(severity_rank(F.col("severity"))).alias("__rank"), F.sort_array(F.collect_set("mitre")).alias("techniques"),
    )
    risky = summed.filter((F.size("categories") >= least_categories) & (F.col("total") >= least_score))
    return risky.select("component", "n", "categories", "total", "techniques", severity_name(F.least("__rank", F.lit(1))).alias("severity"), F.least("total", F.lit(99)).cast("int").alias("score"))
