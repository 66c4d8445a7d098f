"""Analyst verdicts, and upserts and deletes as versioned rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import first_of_each

VERDICTS = ("true_positive", "false_positive", "benign", "needs_review")


def with_triage(findings: DataFrame, triage: DataFrame, key: str = "id", finding: str = "finding_id") -> DataFrame:
    """findings with verdict and note; untriaged ones keep nulls."""
    own = triage.select(F.col(finding).alias(key), "verdict", "note")
    return findings.join(own, key, "left")


def without_false_positives(findings: DataFrame, triage: DataFrame, key: str = "id", finding: str = "finding_id") -> DataFrame:
    gone = triage.filter(F.col("verdict") == "false_positive").select(F.col(finding).alias(key))
    return findings.join(gone, key, "left_anti")


def triage_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.coalesce("verdict", F.lit("untriaged")).alias("status")).agg(F.count("*").alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: str, updated: str = "updated_at", created: str | None = None, fill: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: the latest, with the earliest `created` and, for columns in `fill`, the latest value that is there."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c != key]
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(updated))) if c in fill else F.max_by(c, updated)
    return both.groupBy(key).agg(*[(F.min(c) if c == created else latest(c)).alias(c) for c in rest])


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def snapshot(rows: DataFrame, most: int | None = 5000, group: str = "artifact", order: str = "row_index") -> tuple[DataFrame, DataFrame]:
    """(rows, cut): the first rows of each artifact, and (artifact, total, kept) of those that have more."""
    kept = first_of_each(rows, [group], [order], most)
    total = rows.groupBy(group).agg(F.count("*").alias("total"))
    cut = total.filter(F.lit(False) if most is None else F.col("total") > most)
    return kept, cut.withColumn("kept", F.lit(most).cast("long"))
