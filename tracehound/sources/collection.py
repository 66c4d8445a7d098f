"""Readers of collections: folders and archives of JSON, CSV and text into rows(host, artifact, row_index, source_file,
row map<string,string>), feeds of hashes, audit logs and incidents."""

from __future__ import annotations

import csv
import io
import json
import tarfile
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracehound.functions.scalars import alias
from tracehound.operators.ordered import first_of_each

from .json_objects import file_name, json_objects
from .staging import near, staged

SCHEMA = "host string, artifact string, row_index long, source_file string, row map<string,string>"
MAP = "map<string,string>"
#: Parts of a text log's file name and the artifact that it becomes.
TEXT_ARTIFACTS = (("authlog", r"auth|secure"), ("apache", r"apache|nginx|access"), ("suricata", r"suricata|eve"), ("zeek_conn", r"zeek|bro"), ("syslog", r"syslog"))
TIMES = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?|[A-Z][a-z]{2}\s+\d{1,2}\s\d{2}:\d{2}:\d{2})"


def _stem(path: Column) -> Column:
    """A file's name without its ending, with _ for dots."""
    return F.translate(F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.(jsonl?|csv|tsv|log|txt)(\.gz)?$", ""), ".", "_")


def _placed(lines: DataFrame, row: Column, artifact: Column, host: str) -> DataFrame:
    """Numbers rows(source_file, block, …) within their file, whose splits are told by `block`, where they start.

    A split's rows come in order in one task, so they count on from the rows of the splits before it, a sum over splits;
    no row is moved for its number.
    """
    out = lines.select(F.lit(host).alias("host"), artifact.alias("artifact"), "source_file", "block", row.alias("row")).filter("row is not null")
    out = staged(out.withColumn("at", F.monotonically_increasing_id()), "collection-rows")
    splits = out.groupBy("source_file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = staged(splits.select(F.col("source_file").alias("__file"), F.col("block").alias("__block"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("__ahead")), "collection-splits")
    placed = out.join(near(splits, splits.count()), (F.col("source_file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    return placed.select("host", "artifact", (F.col("at") + F.col("__ahead")).alias("row_index"), "source_file", "row")


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    return text.select("value", file_name().alias("source_file"), F.col("_metadata.file_block_start").alias("block"))


def _json_row(text: Column) -> Column:
    """An object as a map with nested values as JSON text; null for anything else."""
    return F.when(F.trim(text).startswith("{"), F.from_json(text, MAP))


def read_jsonl(spark: SparkSession, path: str, host: str = "", tolerant: bool = False, pattern: str = "*.jsonl") -> DataFrame:
    """One row a line. Lines that are no objects are dropped, or kept as {raw: line} if tolerant."""
    lines = _lines(spark, path, pattern).filter(F.trim("value") != "")
    row = _json_row(F.col("value"))
    return _placed(lines, F.coalesce(row, F.create_map(F.lit("raw"), F.col("value"))) if tolerant else row, _stem(F.col("source_file")), host)


def read_json(spark: SparkSession, path: str, host: str = "", pattern: str = "*.json") -> DataFrame:
    """Files that hold an array of objects, one object, or objects line by line; see json_objects. Files of any size."""
    objects, by_line = json_objects(spark, path, pattern)
    whole = objects.select(F.lit(host).alias("host"), _stem(F.col("source_file")).alias("artifact"), F.col("element").alias("row_index"), "source_file", F.from_json("text", MAP).alias("row")).filter("row is not null")
    if by_line.isEmpty():
        return whole
    lines = _lines(spark, path, pattern).join(by_line, "source_file", "left_semi").filter(F.trim("value") != "")
    return whole.unionByName(_placed(lines, _json_row(F.col("value")), _stem(F.col("source_file")), host))


def apart(rows: DataFrame) -> DataFrame:
    """rows of a collection whose files of one name have artifacts of their own: the first (*.json before *.jsonl, then by
    path) keeps the name, the others have their folder's name behind it. Files of one name in folders of one name share one."""
    files = rows.select("artifact", F.col("source_file").alias("__file")).distinct()
    order = Window.partitionBy("artifact").orderBy(F.lower("__file").endswith(".jsonl"), "__file")
    renamed = files.withColumn("n", F.row_number().over(order)).filter("n > 1").select("__file", F.concat_ws("_", "artifact", F.regexp_extract("__file", r"([^/]+)/[^/]+$", 1)).alias("__name"))
    both = rows.join(renamed, F.col("source_file") == F.col("__file"), "left")
    return both.withColumn("artifact", F.coalesce("__name", "artifact")).select(*rows.columns)


def sniff_separator(sample: str) -> str:
    """The separator that all lines of a sample hold equally often, of comma, tab, semicolon and bar."""
    lines = [x for x in sample.splitlines() if x][:20]
    best = [(min(x.count(s) for x in lines), s) for s in ",\t;|" if lines and len({x.count(s) for x in lines}) == 1]
    return max(best, default=(0, max(",\t;|", key=lambda s: sample.count(s))))[1]


def read_csv(spark: SparkSession, path: str, host: str = "", separator: str | None = None, artifact: str = "siem_export") -> DataFrame:
    """Rows by the header's names. Files may differ in separator and header: those that begin with the same line are read
    together, and the separator is told from that line if not given. The first lines of the files come to the driver, one
    for each different one. Where a file's first line holds no separator its lines are kept as {raw: line}."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    heads = lines.filter((F.col("block") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.min_by("value", "at").alias("head"))
    groups = heads.groupBy("head").agg(F.collect_set("file").alias("files"))
    parts = []
    for r in groups.orderBy("head").toLocalIterator():
        own = separator or sniff_separator(r["head"])
        if own not in r["head"]:
            raw = lines.filter(F.col("file").isin(*r["files"]) & (F.trim("value") != "")).select(F.create_map(F.lit("raw"), F.col("value")).alias("r"), F.col("file").alias("source_file"), "block")
            parts.append(raw)
            continue
        df = spark.read.option("header", "true").option("sep", own).option("mode", "PERMISSIVE").csv([unquote(f) for f in r["files"]])
        names = list(df.columns)
        row = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"`{n}`") for n in names])), lambda _, v: v.isNotNull())
        parts.append(df.select(row.alias("r"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block")))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return _placed(both, F.col("r"), F.lit(artifact), host)


def text_artifact(path: Column) -> Column:
    name, out = F.lower(F.regexp_extract(path, r"([^/\\]+)$", 1)), None
    for artifact, pattern in TEXT_ARTIFACTS:
        out = (F if out is None else out).when(name.rlike(pattern), artifact)
    return out.otherwise("textlog")


def read_text(spark: SparkSession, path: str, host: str = "", pattern: str = "*") -> DataFrame:
    """Lines that are not blank, with the first time stamp in them; the artifact is told from the file's name."""
    lines = _lines(spark, path, pattern).filter(F.trim("value") != "")
    time = F.regexp_extract("value", TIMES, 1)
    return _placed(lines, F.create_map(F.lit("raw"), F.col("value"), F.lit("timestamp"), time), text_artifact(F.col("source_file")), host)


def _members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield unquote(m.filename), z.read(m)
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()


def _objects(name: str, text: str) -> Iterator[dict]:
    if name.endswith(".csv"):
        yield from csv.DictReader(io.StringIO(text), delimiter=sniff_separator(text[:4096]))
    elif name.endswith(".jsonl") or "\n{" in text[:1000]:
        for line in text.splitlines():
            try:
                value = json.loads(line)
            except ValueError:
                continue
            if isinstance(value, dict):
                yield value
    else:
        value = json.loads(text)
        yield from (v for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict))


def read_archives(spark: SparkSession, path: str, host: str = "") -> DataFrame:
    """Members *.json, *.jsonl and *.csv of ZIP and tar archives: one archive a task, its members one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"]):
                for member, data in _members(path_, content):
                    if not member.lower().endswith((".json", ".jsonl", ".csv")):
                        continue
                    stem = member.replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[0].replace(".", "_")
                    try:
                        rows = [{str(k): v if isinstance(v, str) else json.dumps(v) for k, v in r.items() if v is not None} for r in _objects(member.lower(), data.decode("utf-8-sig", "replace"))]
                    except ValueError:
                        continue
                    for low in range(0, len(rows), 10_000):
                        some = rows[low : low + 10_000]
                        yield pd.DataFrame({"host": host, "artifact": stem, "row_index": range(low, low + len(some)), "source_file": f"{path_}!{member}", "row": some})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.lower("path").rlike(r"\.(zip|tar|tgz|tar\.gz)$"))
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_collection(spark: SparkSession, path: str, host: str = "") -> DataFrame:
    """By the path's ending: archive, JSON, JSON lines, CSV or text; a folder is read for JSON and JSON lines."""
    low = path.lower()
    if low.endswith((".zip", ".tar", ".tgz", ".tar.gz")):
        return read_archives(spark, path, host)
    if low.endswith(".jsonl"):
        return read_jsonl(spark, path, host)
    if low.endswith(".json"):
        return read_json(spark, path, host)
    if low.endswith((".csv", ".tsv")):
        return read_csv(spark, path, host)
    if low.endswith((".log", ".txt")):
        return read_text(spark, path, host)
    return apart(read_json(spark, path, host).unionByName(read_jsonl(spark, path, host)))


def totals(rows: DataFrame) -> DataFrame:
    """(artifact, rows) of a collection."""
    return rows.groupBy("artifact").agg(F.count("*").alias("rows"))


def collection_totals(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """One row: files and bytes at a path, whose contents are not read, and artifacts and rows of what was read from there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    read = totals(rows).agg(F.sort_array(F.collect_set("artifact")).alias("artifacts"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return files.join(read, F.lit(True))  # One row each.


def read_hash_feed(spark: SparkSession, path: str) -> DataFrame:
    """(hash, note) of lines `hash[, or space]note`; # begins a comment; of one hash's notes the last line's holds."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = lines.select("at", F.lower(F.regexp_extract("line", r"^([^\s,]+)", 1)).alias("hash"), F.trim(F.regexp_extract("line", r"^[^\s,]+[\s,]+(.*)$", 1)).alias("note"))
    return parts.filter(F.col("hash").rlike("^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$")).groupBy("hash").agg(F.max_by("note", "at").alias("note"))


def append_audit(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, event: str | None = None, most: int = 100) -> DataFrame:
    """The newest audit records, of one event if given."""
    rows = spark.read.json(path)
    return (rows if event is None else rows.filter(F.col("event") == event)).orderBy(F.desc("ts")).limit(most)


def audit_totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).groupBy("event").agg(F.count("*").alias("n"))


def list_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.orderBy(F.desc("updated_at"), "id")


def count_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.count("*").alias("n"))


def get_incident(incidents: DataFrame, id_: str) -> DataFrame:
    return incidents.filter(F.col("id") == id_)


def collection_log(rows: DataFrame, most: int | None = 20) -> DataFrame:
    """(level, row_index, message): the first warnings and the first errors of rows(row_index, row) of a collector's log."""
    row = F.col("row")
    level = F.lower(alias(row, "level", "Level", "severity"))
    kind = F.when(level.isin("error", "err", "fatal", "critical"), "error").when(level.isin("warn", "warning"), "warning")
    told = rows.select(kind.alias("level"), "row_index", alias(row, "message", "Message", "msg").alias("message")).filter("level is not null")
    return told if most is None else first_of_each(told, ["level"], ["row_index"], most)


def collection_metadata(rows: DataFrame) -> DataFrame:
    """(key, value) of the collection's own description: its host, client, flow, times and artifacts; the first of each."""
    held = rows.select("row_index", F.explode("row").alias("key", "value")).filter(F.lower("key").isin("client_id", "session_id", "flow_id", "hostname", "fqdn", "os", "create_time", "start_time", "active_time", "artifacts", "state", "total_collected_rows", "total_uploaded_files"))
    return held.groupBy(F.lower("key").alias("key")).agg(F.min_by("value", "row_index").alias("value"))
