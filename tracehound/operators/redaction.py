"""Redaction of personal and internal identifiers with stable numbered placeholders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.functions.scalars import any_of
from tracehound.functions.tables import KNOWN_EXTERNAL_DOMAINS, PII_PATTERNS, SAFE_ADDRESSES, SYSTEM_ACCOUNTS, SYSTEM_SIDS
from tracehound.sources.staging import near, spread, staged

#: Bytes of texts that are sent to every task.
SENT_BYTES = 32 << 20


def pattern_of(category_pattern: tuple[str, str, int]) -> str:
    return f"(?i){category_pattern[1]}" if category_pattern[2] else category_pattern[1]


def exempt(category: Column, value: Column) -> Column:
    """Values that identify nobody: loopback addresses, system accounts and ids, well-known domains, short host names."""
    account = F.upper(F.element_at(F.split(value, r"[\\@]"), 1)).isin(*[a.upper() for a in SYSTEM_ACCOUNTS]) | F.upper(F.element_at(F.split(value, r"[\\@]"), -1)).isin(*[a.upper() for a in SYSTEM_ACCOUNTS])
    return (
        (category.isin("private_ip", "public_ip") & value.isin(*SAFE_ADDRESSES))
        | (category.isin("ad_identity", "upn_identity") & account)
        | ((category == "sid") & any_of([(value == s) | value.startswith(s + "-") for s in SYSTEM_SIDS]))
        | ((category == "external_fqdn") & any_of([(F.lower(value) == d) | F.lower(value).endswith("." + d) for d in KNOWN_EXTERNAL_DOMAINS]))
        | ((category == "hostname") & (F.char_length(value) < 4))
    )


def candidates(rows: DataFrame, key: str, text: str, patterns=PII_PATTERNS) -> DataFrame:
    """(key, category, value, priority) of everything that a pattern finds; the pattern first in the list has priority."""

    def values(n: int, pattern: tuple[str, str, int]) -> Column:
        entry = lambda v: F.struct(F.lit(n).alias("priority"), F.lit(pattern[0]).alias("category"), v.alias("value"))
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern_of(pattern)), F.lit(0)), entry)

    found = [values(n, p) for n, p in enumerate(patterns)]
    out = rows.filter(F.col(text).isNotNull()).select(key, F.explode(F.flatten(F.array(*found))).alias("m")).select(key, "m.*")
    return out.filter(~exempt(F.col("category"), F.col("value")))


def dictionary(found: DataFrame) -> DataFrame:
    """(original, category, anonymized): one placeholder a value, numbered within its category by value.

    A value that several patterns find takes the first one's category. Numbers are global to a category: each range of
    values counts its own and adds the counts of the ranges before.
    """
    values = found.groupBy(F.col("value").alias("original")).agg(F.min_by("category", "priority").alias("category"))
    parts = staged(values.repartitionByRange("category", "original").withColumn("part", F.spark_partition_id()), "pii-values")
    before = Window.partitionBy("category").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("category", "part").agg(F.count("*").alias("n")).select("category", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("category", "part").orderBy("original")) + F.col("start")
    return parts.join(starts, ["category", "part"]).select("original", "category", F.concat(F.lit("["), F.upper("category"), F.lit("_"), number.cast("string"), F.lit("]")).alias("anonymized"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value made once a row however often `then` names it, also where a filter on the result is moved."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _replace(own: DataFrame, rows: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """own(key, pairs): each text with its own pairs replaced in one pass from left to right, longer values first.

    The row's values are one regular expression; the text is what stands between its matches and, in turn, what the matches
    stand for. All of it is Column code: no row leaves the JVM.
    """
    by_length = lambda pairs: F.array_sort(pairs, lambda x, y: F.char_length(y["a"]) - F.char_length(x["a"]))
    quoted = lambda v: F.concat(F.lit("\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    whole = F.col(text)

    def told(expression: Column) -> Column:
        shown = lambda table: F.transform(F.regexp_extract_all(whole, expression, F.lit(0)), lambda m: table[m])
        between = F.split(whole, expression, -1)
        return F.array_join(F.zip_with(between, _once(F.map_from_entries("pairs"), shown), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    replaced = _once(F.array_join(F.transform(by_length(F.col("pairs")), lambda p: quoted(p["a"])), "|"), told)
    return rows.join(own, key, "left").withColumn(out, F.when(F.size("pairs") > 0, replaced).otherwise(whole)).drop("pairs")


def _by_text(rows: DataFrame, key: str, text: str, out: str, work: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """rows with `out` as work(rows, key) makes it of their texts: of each different text once, where copies are half of the rows or more."""
    n, kinds = rows.agg(F.count("*"), F.approx_count_distinct(text)).first()
    if 2 * kinds > n:
        return work(spread(rows), key)
    texts = staged(rows.select(text).distinct().withColumn("__t", F.monotonically_increasing_id()), "pii-texts")
    made = staged(work(spread(texts), "__t").select(F.col(text).alias("__same"), out), "pii-made")
    n, size = made.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__same") + F.octet_length(out)), F.lit(0))).first()
    return rows.join(near(made, n) if size <= SENT_BYTES else made, F.col(text) == F.col("__same"), "left").drop("__same")


def redact(rows: DataFrame, key: str, text: str, out: str = "redacted", patterns=PII_PATTERNS) -> tuple[DataFrame, DataFrame]:
    """(rows with `out`, dictionary). Each row meets only the values that it holds."""
    mapping = None

    def hidden(rows: DataFrame, key: str) -> DataFrame:
        nonlocal mapping
        found = staged(candidates(rows, key, text, patterns).select(key, "category", "value", "priority").distinct(), "pii-found")
        mapping = staged(dictionary(found), "pii-dictionary")
        pairs = found.select(key, "value").distinct().join(mapping, F.col("value") == F.col("original"))
        own = pairs.groupBy(key).agg(F.collect_list(F.struct(F.col("original").alias("a"), F.col("anonymized").alias("b"))).alias("pairs"))
        return _replace(own, rows, key, text, out)

    return _by_text(rows, key, text, out, hidden), mapping


def restore(rows: DataFrame, key: str, text: str, mapping: DataFrame, out: str = "restored") -> DataFrame:
    """Placeholders back to what they stand for."""

    def back(rows: DataFrame, key: str) -> DataFrame:
        held = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\[[A-Z0-9_]+_\d+\]"), F.lit(0)))).alias("anonymized"))
        own = held.join(mapping, "anonymized").groupBy(key).agg(F.collect_list(F.struct(F.col("anonymized").alias("a"), F.col("original").alias("b"))).alias("pairs"))
        return _replace(own, rows, key, text, out)

    return _by_text(staged(rows, "pii-hidden"), key, text, out, back)


def merge_mappings(known: DataFrame, new: DataFrame) -> DataFrame:
    """known, and those of new with an (original, anonymized) that known lacks."""
    return known.unionByName(new.join(known, ["original", "anonymized"], "left_anti"))
