"""The findings relation: emission, ids, de-duplication, counts, order and allowlist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.functions.scalars import SEVERITIES, any_of, severity_rank
from tracehound.functions.tables import TRUSTED_ROOTS

from . import slices

#: category, severity, title, description, artifact, evidence, score, mitre, and where the row was.
COLUMNS = ("category", "severity", "title", "description", "artifact", "evidence", "score", "mitre", "host", "row_index", "source_file")


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _fields(category, severity, title, description, score, mitre, evidence: dict[str, Column] | None) -> dict[str, Column]:
    pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (evidence or {}).items()]
    kept = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull() & (p["value"] != ""))) if pairs else F.create_map().cast("map<string,string>")
    return {"category": _column(category), "severity": _column(severity), "title": _column(title), "description": _column(description), "evidence": kept, "score": _column(score).cast("int"), "mitre": _column(mitre)}


def _placed(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    place = {c: F.col(c) if c in rows.columns else F.lit(None) for c in ("host", "artifact", "row_index", "source_file")}
    fields = fields | {"artifact": place["artifact"].cast("string"), "host": place["host"].cast("string"), "row_index": place["row_index"].cast("long"), "source_file": place["source_file"].cast("string")}
    return rows.select(*[fields[c].alias(c) for c in COLUMNS])


def emit(rows: DataFrame, category, severity, title, description, score, mitre="", evidence: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One finding for each row (for which `where` holds) of rows with host, artifact, row_index, source_file.

    Evidence values are strings; absent and empty ones are left out.
    """
    rows = rows if where is None else rows.filter(where)
    return _placed(rows, _fields(category, severity, title, description, score, mitre, evidence))


@dataclass
class Branch:
    """Findings of rows that are still to be emitted: for each row one, or one for each of `matches`, which the fields
    call m; see branch()."""

    rows: DataFrame
    fields: dict[str, Column]
    where: Column
    matches: Column | None


def branch(rows: DataFrame, category, severity, title, description, score, mitre="", evidence: dict[str, Column] | None = None, where: Column | None = None, matches: Column | None = None) -> Branch:
    """As emit(), but left to union(), which emits all branches of the same rows in one pass. matches is an array of
    signature matches; without any there is no finding."""
    return Branch(rows, _fields(category, severity, title, description, score, mitre, evidence), F.coalesce(where, F.lit(False)) if where is not None else F.lit(True), matches)


MATCH = "struct<n:int,label:string,severity:string,pattern:string>"


def _one_pass(branches: list[Branch]) -> DataFrame:
    """One array of (branch, match) a row, exploded once; then each field by its branch."""
    none = F.lit(None).cast(MATCH)

    def hits(i: int, b: Branch) -> Column:
        one = F.array(F.struct(F.lit(i).alias("k"), none.alias("m"))) if b.matches is None else F.transform(b.matches, lambda m: F.struct(F.lit(i).alias("k"), m.cast(MATCH).alias("m")))
        return F.coalesce(F.when(b.where, one), F.array().cast(f"array<struct<k:int,m:{MATCH}>>"))

    rows = branches[0].rows.withColumn("__hit", F.explode(F.flatten(F.array(*[hits(i, b) for i, b in enumerate(branches)]))))
    rows = rows.withColumns({"__k": F.col("__hit.k"), "m": F.col("__hit.m")}).drop("__hit")
    fields = {}
    for name in branches[0].fields:
        out = None
        for i, b in enumerate(branches):
            out = (F if out is None else out).when(F.col("__k") == i, b.fields[name])
        fields[name] = out
    return _placed(rows, fields)


def union(*parts: DataFrame | Branch) -> DataFrame:
    """All findings of tables and branches; rows that several branches share are read once."""
    tables, passes = [p for p in parts if isinstance(p, DataFrame)], {}
    for p in parts:
        if isinstance(p, Branch):
            passes.setdefault(id(p.rows), []).append(p)
    tables += [_one_pass(branches) for branches in passes.values()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def identity(findings: DataFrame, prefix: str = "F") -> DataFrame:
    """findings with `id`, a hash of what makes the finding: the same on every run and for any partitioning."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("host", "artifact", "row_index", "category", "title", "severity", "mitre")]
    return findings.withColumn("id", F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\x01", *parts), 256), 1, 16)))


def numbered(findings: DataFrame, prefix: str = "F") -> DataFrame:
    """findings with ids F-0001 ... in report order, over all of them; findings alike in all that orders them are told apart by
    the rest of the row."""
    order = {"__rank": severity_rank(F.col("severity")), "__score": -F.col("score"), "__rest": F.xxhash64(*[c for c, kind in findings.dtypes if not kind.startswith("map")])}
    out = slices.numbered(findings.withColumns(order), ["__rank", "__score", "title", "artifact", "row_index", "__rest"], "__n", "findings-numbered")
    return out.withColumn("id", F.format_string(prefix + "-%04d", F.col("__n"))).drop("__n", *order)


def locator(row_index: Column, source_file: Column) -> Column:
    return F.concat(F.coalesce(source_file, F.lit("?")), F.lit("#"), F.coalesce(row_index.cast("string"), F.lit("?")))


def dedup(findings: DataFrame, keys: tuple[str, ...] = ("title", "category", "severity", "mitre", "artifact"), order: tuple[str, ...] = ("row_index",), locators: int = 10) -> DataFrame:
    """One row for each combination of keys: the first by `order`, with occurrences and up to ten later locators.

    Each task keeps the few smallest of a group before the shuffle, so a title that stands in every row is cheap.
    """
    place = Window.partitionBy(*keys).orderBy(*order, *[c for c in ("source_file",) if c in findings.columns])
    few = findings.withColumn("__n", F.row_number().over(place)).filter(F.col("__n") <= locators + 1)
    where = locator(F.col("row_index"), F.col("source_file") if "source_file" in findings.columns else F.lit(None))
    rest = [c for c in findings.columns if c not in keys]
    few = few.groupBy(*keys).agg(*[F.min_by(c, "__n").alias(c) for c in rest], F.sort_array(F.collect_list(F.struct("__n", where.alias("l")))).alias("__l"))
    few = few.withColumn("occurrence_locators", F.transform(F.slice("__l", 2, locators), lambda x: x["l"])).drop("__l")
    counts = findings.groupBy(*keys).agg(F.count("*").alias("occurrences"))
    same = [few[k].eqNullSafe(counts[k]) for k in keys]
    joined = few.join(counts, same)
    return joined.select(*[few[c] for c in findings.columns], "occurrences", "occurrence_locators")


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row: total and a column for each severity."""
    return findings.agg(F.count("*").alias("total"), *[F.count_if(F.lower("severity") == s).alias(s) for s in SEVERITIES])


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")), F.desc("score"), *[c for c in ("id", "title", "row_index") if c in findings.columns])


def suppressed(severity: Column, path: Column, arguments: Column, category: Column) -> Column:
    """Whether a finding is noise: minor, from a trusted root, without suspicious arguments, in a category of places."""
    roots = any_of([F.lower(path).startswith(r.replace("\\\\", "\\")) for r in TRUSTED_ROOTS])
    odd = F.lower(F.coalesce(arguments, F.lit(""))).rlike(r"-enc|frombase64|downloadstring|iex|hidden|bypass|http")
    return F.coalesce(~F.lower(severity).isin("critical", "high") & roots & ~odd & category.isin("process_anomaly", "persistence", "file_anomaly"), F.lit(False))


def apply_allowlist(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept findings, one row with the number suppressed)."""
    gone = suppressed(F.col("severity"), F.coalesce(F.col("evidence")["path"], F.lit("")), F.col("evidence")["cmdline"], F.col("category"))
    return findings.filter(~gone), findings.agg(F.count_if(gone).alias("suppressed"))
