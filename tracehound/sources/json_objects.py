"""The objects of JSON files of any size and layout, cut apart without reading a file as a whole.

A file is read in chunks that end at each closing brace, so its splits are read by many tasks, whether it has line ends or
not. Quotes before a chunk tell whether it begins inside a string, opening and closing braces before it how deep it begins,
and outermost closing braces which object it belongs to; all three are running sums over the splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.operators.slices import SLICE, running

from .staging import staged

#: A string, or the rest of one that the chunk does not end.
_STRING = r'"[^"]*+("|\z)'
#: What stands before the first brace outside strings, and what is left of a string that began before.
_BEFORE = r'^[^"{]*+(?:"[^"\\]*+(?:(?s:\\.)[^"\\]*+)*+"[^"{]*+)*+'
_REST_OF_STRING = r'^[^"\\]*+(?:(?s:\\.)[^"\\]*+)*+"'


def file_name() -> Column:
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _count(text: Column, character: str) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(character), F.lit("")))).cast("long")


#: Chunks of a split that make a slice, which one task puts in order.
SLICE_CHUNKS = 100_000


def _chunks(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(source_file, block, __slice, at, value, quotes, opens, opens_inside): braces that a chunk opens, if it begins outside
    a string and inside one. A split, told by its start, is slices of so many chunks, numbered on from there: a
    chunk is a byte at least, so no number reaches the start of the next split."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "}").text(path)
    rows = read.select("value", file_name().alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # The lower bits of the number are the chunk's place in its task.
    piece = F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / SLICE_CHUNKS)
    plain = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    rows = rows.select("*", (F.col("block") + piece).alias(SLICE), plain.alias("plain"))
    rows = rows.select("*", _count(F.col("plain"), "{").alias("braces"))
    # A brace is outside strings either if the chunk begins outside one or if it begins inside one.
    opens = F.when(F.col("braces") == 0, 0).otherwise(_count(F.regexp_replace("plain", _STRING, ""), "{"))
    rows = rows.select("source_file", "block", SLICE, "at", "value", _count(F.col("plain"), '"').alias("quotes"), opens.alias("opens"), "braces")
    return rows.withColumn("opens_inside", F.col("braces") - F.col("opens")).drop("braces")


def json_objects(spark: SparkSession, path: str, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(objects, by_line): objects(source_file, element, text), each outermost object of the files at path by its place
    from 0; by_line(source_file), files that hold an object a line, which a reader should take line by line, as one bad line
    is then no harm to those after it. Their objects are left out.

    What stands outside objects is left out, so an array's numbers and strings are; an array inside an array gives its
    objects. A file whose braces do not balance gives the objects before the fault. An object is put together from its
    chunks in one task, and only if it holds others.
    """
    keys, order = ["source_file"], ["at"]
    rows = staged(_chunks(spark, path, pattern), "json-chunks")
    rows = running(rows, keys, order, {"before": ("sum", F.col("quotes"))}, own=False, sent=False)
    inside = F.col("before") % 2 == 1
    rows = rows.withColumn("inside", inside).withColumn("opened", F.when(inside, F.col("opens_inside")).otherwise(F.col("opens")))
    closed = (F.col("before") + F.col("quotes")) % 2 == 0
    rows = rows.withColumn("step", F.col("opened") - closed.cast("long")).withColumn("closed", closed)
    rows = staged(running(rows, keys, order, {"depth": ("sum", F.col("step"))}, own=False, sent=False).select(*keys, "block", SLICE, "at", "value", "inside", "opened", "step", "closed", "depth"), "json-depths")
    ends = F.col("closed") & (F.col("depth") + F.col("step") == 0) & ((F.col("depth") > 0) | (F.col("opened") > 0))
    rows = running(rows.withColumn("ends", ends), keys, order, {"element": ("sum", F.col("ends").cast("long"))}, own=False, sent=False)
    rows = staged(rows.filter("depth >= 0"), "json-elements")
    # Object a line: the file begins with a brace, and a second object begins on a line of its own.
    begins = lambda text: F.regexp_extract(text, r"^\uFEFF?\s*(\S)", 1) == "{"
    first = rows.filter("block = 0").groupBy("source_file").agg(F.min_by("value", "at").alias("head")).filter(begins(F.col("head")))
    second = rows.filter("element = 1 and depth = 0").groupBy("source_file").agg(F.min_by("value", F.struct(SLICE, "at")).alias("next")).filter(F.col("next").rlike(r"\n[^\S\n]*\{"))
    by_line = staged(first.join(second, "source_file", "left_semi").select("source_file"), "json-by-line")
    rows = rows.join(by_line, "source_file", "left_anti").filter("depth > 0 or opened > 0")

    def cut(text: Column, inside: Column) -> Column:
        text = F.when(inside, F.regexp_replace(text, _REST_OF_STRING, "")).otherwise(text)
        return F.regexp_replace(F.concat(text, F.lit("}")), _BEFORE, "")

    whole = rows.filter("depth = 0 and ends").select("source_file", "element", cut(F.col("value"), F.col("inside")).alias("text"))
    parts = rows.filter("not (depth = 0 and ends)").groupBy("source_file", "element").agg(F.array_sort(F.collect_list(F.struct(SLICE, "at", "value", "inside", "ends"))).alias("p"))
    parts = parts.filter(F.element_at("p", -1)["ends"])
    joined = F.array_join(F.transform("p", lambda x: x["value"]), "}")
    return whole.unionByName(parts.select("source_file", "element", cut(joined, F.get("p", 0)["inside"]).alias("text"))), by_line
