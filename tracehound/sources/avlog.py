"""Troubleshooting logs of the antivirus: lines to events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Formats of the lines, tried in this order.
DETECTION = r"(\d{4}-\d{2}-\d{2}T[\d:.]+Z)\s+DETECTION_ADD\s+(\S+)\s+(?:file:([^\s,]+)|process:pid:(\d+))"
MEMORY = r"EMS detection:\s*([^,]+),\s*sigseq=\S+,\s*pid=(\d+)"
LOOKUP = r"([A-Za-z]:\\[^\s,]+)\s+.*?[Ss]ha1[:\s]+([0-9a-fA-F]{40}).*?[Ss]ha2[56]*[:\s]+([0-9a-fA-F]{64})"
IMPACT = r"(\d{4}-\d{2}-\d{2}T[\d:.]+Z)\s+ProcessImageName:\s*([^,]+),\s*TotalTime:\s*(\d+),\s*Count:\s*(\d+).*?MaxTimeFile:\s*([^,]+?)(?:->)?,\s*EstimatedImpact:\s*([\d.]+)%"


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Other columns of lines + (event_type, timestamp, threat_name, file, pid, sha1, sha256, process, files_accessed,
    max_time_file, estimated_impact_pct, raw); lines that no format fits are dropped."""
    text = F.col(line)
    get = lambda pattern, i: F.trim(F.regexp_extract(text, pattern, i))
    kind = F.when(text.rlike(DETECTION), "detection").when(text.rlike(MEMORY), "ems_detection").when(text.rlike(LOOKUP), "sdn").when(text.rlike(IMPACT), "estimated_impact")
    of = lambda **by: F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in by.items()], F.lit(""))
    return lines.withColumn("event_type", kind).filter("event_type is not null").select(
        *[c for c in lines.columns if c != line], "event_type", of(detection=get(DETECTION, 1), estimated_impact=get(IMPACT, 1)).alias("timestamp"), of(detection=get(DETECTION, 2), ems_detection=get(MEMORY, 1)).alias("threat_name"),
        of(detection=get(DETECTION, 3), sdn=get(LOOKUP, 1)).alias("file"), of(detection=get(DETECTION, 4), ems_detection=get(MEMORY, 2)).alias("pid"), of(sdn=get(LOOKUP, 2)).alias("sha1"), of(sdn=get(LOOKUP, 3)).alias("sha256"),
        of(estimated_impact=get(IMPACT, 2)).alias("process"), of(estimated_impact=get(IMPACT, 4)).alias("files_accessed"), of(estimated_impact=get(IMPACT, 5)).alias("max_time_file"), of(estimated_impact=get(IMPACT, 6)).alias("estimated_impact_pct"),
        F.substring(text, 1, 300).alias("raw"),
    )


def expand_logs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(filename, lines array<string>, error) to (events, counts by event type); unreadable files are left out."""
    lines = files.filter(F.col("error").isNull() | (F.col("error") == "")).select(F.col("filename").alias("source_file"), F.posexplode("lines").alias("row_index", "line"))
    events = parse_lines(lines.filter(F.trim("line") != ""))
    return events, events.groupBy("event_type").agg(F.count("*").alias("n"))
