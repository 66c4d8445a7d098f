"""Search: vectors, keywords, text, and a budget of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.functions.scalars import cosine


def nearest(rows: DataFrame, vector: str, query: list[float], k: int, key: str, least: float = 0.1) -> DataFrame:
    """The k rows of highest cosine to a query vector, at least `least`; score to three decimals."""
    score = F.round(cosine(F.col(vector), F.array(*map(F.lit, query))), 3)
    return rows.withColumn("score", score).filter(F.col("score") >= least).orderBy(F.desc("score"), key).limit(k)


def keyword_terms(text: Column) -> Column:
    """Lower-cased words of two letters or digits and more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]{2,})"), F.lit(1))


def keyword_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): term counts over the length of the vector of counts."""
    terms = rows.select(key, F.explode(keyword_terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return terms.select(key, "term", (F.col("n") / norm).alias("weight"))


def keyword_search(index: DataFrame, key: str, query: str, k: int, least: float = 0.1) -> DataFrame:
    """The k keys of highest cosine to a query's terms; only postings of these terms are read."""
    terms = [t for t in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in query).split() if len(t) > 1]
    weights = {t: terms.count(t) for t in terms}
    norm = sum(n * n for n in weights.values()) ** 0.5 or 1.0
    of_query = F.lit(0.0)
    for t, n in weights.items():
        of_query = F.when(F.col("term") == t, F.lit(n / norm)).otherwise(of_query)
    hits = index.filter(F.col("term").isin(*weights)).groupBy(key).agg(F.round(F.sum(F.col("weight") * of_query), 3).alias("score"))
    return hits.filter(F.col("score") >= least).orderBy(F.desc("score"), key).limit(k)


def within_budget(rows: DataFrame, text: str, rank: str, budget: int, group: list[str] | None = None) -> DataFrame:
    """The first rows by rank whose texts together, each with a line end, stay within a number of characters; for the
    rows of each group, or for all rows, which should then be a search's few results."""
    order = Window.partitionBy(*(group or [])).orderBy(rank)
    return rows.withColumn("used", F.sum(F.char_length(text) + 1).over(order)).filter(F.col("used") <= budget)


def contains(rows: DataFrame, columns: list[str], needle: str) -> DataFrame:
    return rows.filter(F.coalesce(F.lower(F.concat_ws(" ", *columns)).contains(needle.lower()), F.lit(False)))


def frequency_class(n: Column) -> Column:
    return F.when(n <= 3, "rare").when(n <= 20, "uncommon").otherwise("common")


def finding_text(findings: DataFrame) -> Column:
    """A finding as one searchable text: title, description, category, technique, severity and evidence values, each cut at
    100 characters."""
    evidence = F.transform(F.map_values("evidence"), lambda v: F.substring(v, 1, 100))
    parts = F.concat(F.array("title", "description", "category", "mitre", "severity"), F.coalesce(evidence, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def finding_index(findings: DataFrame, key: str = "id") -> DataFrame:
    """The term index of findings by their text."""
    return keyword_index(findings.withColumn("__text", finding_text(findings)), key, "__text")
