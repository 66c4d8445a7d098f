"""Content rules over the bytes of files: which files are scanned, and a declarative rule scan."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.functions.literals import Literal, literal_hits
from tracehound.functions.tables import SCANNABLE_EXTENSIONS, SECURITY_SOFTWARE_PATHS

from .json_objects import file_name

MOST_BYTES = 50 * 1024 * 1024


@dataclass(frozen=True)
class ContentRule:
    """Named strings, and alternatives of conjunctions of (names, least number of them found). nocase and wide hold for all
    strings but those named in `exact`, which are looked for as they stand."""

    name: str
    severity: str
    mitre: str
    description: str
    strings: dict[str, str]
    condition: tuple[tuple[tuple[tuple[str, ...], int], ...], ...]
    nocase: bool = True
    wide: bool = True
    tags: tuple[str, ...] = ()
    exact: tuple[str, ...] = ()


def _any(*names: str) -> tuple[tuple[str, ...], int]:
    return names, 1


#: The rules that come with the library.
RULES = (
    ContentRule("SUSP_PowerShell_Encoded_Command_In_File", "high", "T1059.001", "Encoded PowerShell command with execution", {"enc1": "-EncodedCommand", "enc2": "-enc ", "enc3": "FromBase64String", "iex": "Invoke-Expression"}, ((_any("enc1", "enc2", "enc3"), _any("iex")),)),
    ContentRule("SUSP_Mimikatz_Strings", "critical", "T1003.001", "Credential dumping strings", {"a": "sekurlsa", "b": "mimikatz", "c": "lsadump", "d": "kerberos::", "e": "crypto::"}, (((("a", "b", "c", "d", "e"), 2),),)),
    ContentRule("SUSP_CobaltStrike_Beacon_Indicators", "critical", "T1071.001", "Beacon configuration markers", {"a": "beacon.dll", "b": "%s as %s\\%s: %d", "c": "ReflectiveLoader", "d": "%%IMPORT%%"}, (((("a", "b", "c", "d"), 2),),), exact=("b", "d")),
    ContentRule("SUSP_Webshell_Common_Patterns", "high", "T1505.003", "Web shell execution patterns", {"php1": "eval($_POST", "php2": "eval($_GET", "php3": "system($_REQUEST", "asp1": "eval(Request", "jsp1": "Runtime.getRuntime().exec(request"}, ((_any("php1", "php2", "php3", "asp1", "jsp1"),),), wide=False),
    ContentRule("SUSP_Ransomware_Note_Indicators", "high", "T1486", "Ransom note language with a payment channel", {"a": "your files have been encrypted", "b": "all your files", "c": "to decrypt your files", "d": "bitcoin", "e": ".onion"}, ((_any("a", "b", "c"), _any("d", "e")),)),
)


def scannable(path: Column, length: Column, most: int | None = MOST_BYTES, endings: tuple[str, ...] = SCANNABLE_EXTENSIONS) -> Column:
    """One byte to `most` bytes (any number if None), one of the endings, and not in a folder of security software."""
    # Each list is one expression, so that the path, which stands in every piece of a file, is read once for it.
    listed = lambda texts: "|".join(re.escape(t) for t in texts)
    ending = F.lower(path).rlike(rf"(?:{listed(endings)})\z") if endings else F.lit(False)
    size = length >= 1 if most is None else length.between(1, most)
    return size & ending & ~F.lower(F.translate(path, "/", "\\")).rlike(listed(dict.fromkeys(p.replace("/", "\\") for p in SECURITY_SOFTWARE_PATHS)))


def read_files(spark: SparkSession, folder: str, most: int | None = MOST_BYTES, endings: tuple[str, ...] = SCANNABLE_EXTENSIONS) -> DataFrame:
    """(path, block, at, bytes): the files to scan in pieces that end at the byte of a line end, with the split that a piece is of
    and its place there. A large file is read by many tasks; no string that is looked for has a line end in it."""
    read = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(folder)
    rows = read.filter(scannable(F.col("_metadata.file_path"), F.col("_metadata.file_size"), most, endings))
    return rows.select(file_name().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("bytes"))


def _spelt(text: str, wide: bool) -> str:
    """The bytes of a string, each as the character of that number."""
    plain = text.encode("utf-8")
    return (b"".join(bytes([b, 0]) for b in plain) if wide else plain).decode("latin-1")


def _folded(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def scan_files(files: DataFrame, rules: tuple[ContentRule, ...] = RULES) -> DataFrame:
    """(rule, severity, mitre, description, filename, matched_strings, tags) for each file and rule that match; up to
    three snippets of 40 bytes, of the rule's strings in their order, each where it first stands.

    All strings of all rules are looked for at once in each piece of files(path, block, at, bytes); what a file holds is then
    brought together, one row a string, and the conditions are tried on that.
    """
    strings = [(r, name, text) for r, rule in enumerate(rules) for name, text in rule.strings.items()]
    numbers = {(r, name): i for i, (r, name, _) in enumerate(strings)}
    literals, table = [], []
    for i, (r, name, text) in enumerate(strings):
        rule = rules[r]
        fold, wide = rule.nocase and name not in rule.exact, rule.wide and name not in rule.exact
        spelt = [_folded(x) if fold else x for x in [_spelt(text, False)] + ([_spelt(text, True)] if wide else [])]
        literals += [Literal(i, "contains", int(fold), x) for x in spelt]
        table.append({"rule": r, "fold": fold, "spelt": spelt})
    known = F.from_json(F.lit(json.dumps(table)), "array<struct<rule:int,fold:boolean,spelt:array<string>>>")
    characters = F.decode("bytes", "ISO-8859-1")
    rows = files.select("path", "block", "at", characters.alias("own"))
    rows = rows.withColumn("fold", F.translate("own", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    hits = rows.withColumn("hits", literal_hits([F.col("own"), F.col("fold")], literals)["ids"]).select("path", "block", "at", "own", "fold", F.explode("hits").alias("string"))
    entry = F.get(known, F.col("string"))
    where = F.filter(F.transform(entry["spelt"], lambda x: F.struct(F.instr(F.when(entry["fold"], F.col("fold")).otherwise(F.col("own")), x).alias("p"), F.char_length(x).alias("n"))), lambda x: x["p"] > 0)
    place = F.array_min(where)
    shown = F.translate(F.substring("own", place["p"], F.least(place["n"], F.lit(40))), "\0", "")
    shown = F.encode(shown, "ISO-8859-1").cast("string")
    # One row of a file for each string that it holds.
    held = hits.select("path", "string", F.struct("block", "at").alias("place"), shown.alias("shown")).groupBy("path", "string").agg(F.min_by("shown", "place").alias("shown"))
    per_rule = held.groupBy("path", F.get(known, F.col("string"))["rule"].alias("r")).agg(F.array_sort(F.collect_list(F.struct("string", "shown"))).alias("held"))
    described = [
        {"rule": r.name, "severity": r.severity, "mitre": r.mitre, "description": r.description, "tags": list(r.tags), "ways": [[{"strings": [numbers[i, n] for n in names], "least": least} for names, least in way] for way in r.condition]}
        for i, r in enumerate(rules)
    ]
    told = F.get(F.from_json(F.lit(json.dumps(described)), "array<struct<rule:string,severity:string,mitre:string,description:string,tags:array<string>,ways:array<array<struct<strings:array<int>,least:int>>>>>"), F.col("r"))
    found = F.transform("held", lambda h: h["string"])
    matches = F.exists("ways", lambda way: F.forall(way, lambda part: F.size(F.array_intersect(part["strings"], F.col("found"))) >= part["least"]))
    per_rule = per_rule.select("path", found.alias("found"), F.slice(F.transform("held", lambda h: h["shown"]), 1, 3).alias("matched_strings"), told.alias("t")).select("*", "t.*")
    return per_rule.filter(matches).select("rule", "severity", "mitre", "description", F.col("path").alias("filename"), "matched_strings", "tags")
