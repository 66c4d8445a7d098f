"""Event rules: a declarative rule (dict or YAML) compiled to one boolean Column.

Rules have detection selections (lists are alternatives, mappings are conjunctions of field|modifier: value) and a
condition over selection names with and, or, not, parentheses and `1 of x*`, `all of them`.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracehound.functions.scalars import any_of
from tracehound.functions.tables import FIELD_ALIASES, LOGSOURCE_ARTIFACTS

from .rule_index import AtomIndex, Node, matching

#: Score by level, and the highest severity that a rule alone gives.
LEVEL_SCORES = {"critical": 70, "high": 60, "medium": 45, "low": 25, "informational": 10}
LEVEL_SEVERITIES = {"critical": "high", "high": "high", "medium": "medium", "low": "low", "informational": "info"}
#: Parts of file names, and whole descriptions, of rules that only say that an event took place.
NOISE_FILES = ("_rulealert", "rulealert.yml", "sysmon_1_high_procexec", "sysmon_1_high_proc", "_nonexeprocexec", "_sysmonalert")
NOISE_DESCRIPTIONS = ("sysmon process creation", "sysmon file create", "sysmon dll load", "sysmon network connection", "sysmon registry event", "sysmon process access", "sysmon raw access read", "sysmon pipe created", "sysmon image loaded")
#: Fields that fall back to the whole row's text.
WHOLE_ROW_FIELDS = ("CommandLine", "Image", "ScriptBlockText")


@dataclass
class Rule:
    title: str
    detection: dict
    level: str = "medium"
    tags: list[str] = field(default_factory=list)
    logsource: dict = field(default_factory=dict)
    id: str = ""

    @property
    def condition(self) -> str:
        c = self.detection.get("condition", "")
        return " or ".join(f"({x})" for x in c) if isinstance(c, list) else str(c)

    @property
    def aggregates(self) -> bool:
        return "|" in self.condition

    @property
    def technique(self) -> str:
        return next((t.removeprefix("attack.").upper() for t in self.tags if re.fullmatch(r"attack\.t\d{4}(\.\d{3})?", t)), "")

    def applies_to(self, artifact: str) -> bool:
        """By the category's artifact name fragments, else by the service's name."""
        category, service = self.logsource.get("category"), self.logsource.get("service")
        if category in LOGSOURCE_ARTIFACTS:
            return any(x in artifact.lower() for x in LOGSOURCE_ARTIFACTS[category])
        return bool(service) and service.lower() in artifact.lower()

    def fields(self) -> set[str]:
        found = set()
        for name, selection in self.detection.items():
            if name != "condition":
                for part in selection if isinstance(selection, list) else [selection]:
                    if isinstance(part, dict):
                        found |= {k.split("|")[0] for k in part}
        return found


def load_rules(text: str, file: str = "") -> tuple[list[Rule], dict[str, int]]:
    """Rules of a multi-document YAML text, and how many were left out and why; file is the name it was read from."""
    import yaml

    rules, left = [], {"empty": 0, "no condition": 0, "aggregation": 0, "noise": 0}
    for doc in yaml.safe_load_all(text):
        if not isinstance(doc, dict) or not isinstance(doc.get("detection"), dict):
            left["empty"] += 1
            continue
        rule = Rule(str(doc.get("title", "")), doc["detection"], str(doc.get("level", "medium")).lower(), [str(t).lower() for t in doc.get("tags") or []], doc.get("logsource") or {}, str(doc.get("id", "")))
        if not rule.condition:
            left["no condition"] += 1
        elif rule.aggregates:
            left["aggregation"] += 1
        elif any(part in file.lower() for part in NOISE_FILES) or str(doc.get("description", "")).lower().strip() in NOISE_DESCRIPTIONS:
            left["noise"] += 1
        else:
            rules.append(rule)
    return rules, left


def read_rules(spark: SparkSession, folder: str) -> tuple[list[Rule], dict[str, int]]:
    """The rules of all *.yml and *.yaml files of a folder, which may be changed and read again; rule files are few and
    small, and come to the driver, where plans are made."""
    rules, left = [], {}
    for r in spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{yml,yaml}").text(folder).select("value", F.col("_metadata.file_name").alias("file")).orderBy("file").toLocalIterator():
        some, without = load_rules(r["value"], r["file"])
        rules += some
        left = {k: left.get(k, 0) + n for k, n in without.items()}
    return rules, left


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(title, id, level, severity, score, mitre, logsource) of rules, for a listing."""
    rows = [(r.title, r.id, r.level, LEVEL_SEVERITIES.get(r.level, "medium"), LEVEL_SCORES.get(r.level, 45), r.technique, {str(k): str(v) for k, v in r.logsource.items()}) for r in rules]
    return spark.createDataFrame(rows, "title string, id string, level string, severity string, score int, mitre string, logsource map<string,string>")


class Fields:
    """Field access for a table: typed columns by (case-insensitive) name or alias, or a map column of raw fields."""

    def __init__(self, df: DataFrame, raw: str | None = None):
        self.columns = {c.lower(): c for c in df.columns if c != raw}
        self.raw = raw
        own = [F.col(c).cast("string") for c in df.columns if c != raw]
        self.text = F.concat_ws(" ", *([F.map_values(F.col(raw))] if raw else own))

    def has(self, name: str) -> bool:
        return bool(self.raw) or name in WHOLE_ROW_FIELDS or any(n.lower() in self.columns for n in (name, *FIELD_ALIASES.get(name, ())))

    def get(self, name: str) -> Column:
        names = list(dict.fromkeys([name, *FIELD_ALIASES.get(name, ())]))
        found = [F.col(self.columns[n.lower()]).cast("string") for n in names if n.lower() in self.columns]
        if self.raw:
            found += [F.col(self.raw)[n] for n in names]
            found.append(F.try_element_at(F.map_values(F.map_filter(F.col(self.raw), lambda k, _: F.lower(k) == name.lower())), F.lit(1)))
        if name in WHOLE_ROW_FIELDS:
            found.append(self.text)
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def one(self, name: str, expected, modifiers: list[str]) -> Column:
        return _one(self.get(name), expected, modifiers)

    def whole(self, value: str) -> Column:
        return F.coalesce(F.lower(self.text).contains(value.lower()), F.lit(False))

    def never(self) -> Column:
        return F.lit(False)

    def always(self) -> Column:
        return F.lit(True)


def _plain(text: Column) -> Column:
    return F.lower(F.translate(text, "\\", "/"))


def in_network(address: Column, network: str) -> Column:
    """Whether a dotted quad lies in a network like 10.0.0.0/8; false for anything else."""
    base, _, bits = network.partition("/")
    number = lambda parts: sum(int(p) << s for p, s in zip(parts, (24, 16, 8, 0)))
    size = 1 << (32 - int(bits or 32))
    low = number(base.split(".")) // size * size
    quads = F.regexp_extract_all(address, F.lit(r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"), F.lit(0))
    parts = F.split(F.try_element_at(quads, F.lit(1)), r"\.")
    value = sum((F.element_at(parts, i + 1).try_cast("long") * (1 << s) for i, s in enumerate((24, 16, 8, 0))), F.lit(0))
    return F.coalesce(value.between(low, low + size - 1), F.lit(False))


def _one(actual: Column, expected, modifiers: list[str]) -> Column:
    if expected is None:
        return actual.isNull() | (actual == "")
    text = str(expected)
    low = text.lower().replace("\\", "/")
    if "re" in modifiers:
        hit = actual.rlike(f"(?i){text}")
    elif "cidr" in modifiers:
        hit = in_network(actual, text)
    elif "contains" in modifiers:
        options = [low]
        if "windash" in modifiers and "-" in low:
            options.append(low.replace("-", "/"))
        hit = any_of([_plain(actual).contains(o) for o in options])
    elif "startswith" in modifiers:
        hit = _plain(actual).startswith(low)
    elif "endswith" in modifiers:
        hit = _plain(actual).endswith(low)
    else:
        hit = F.lower(actual) == text.lower()
        if re.fullmatch(r"-?\d+(\.\d+)?", text):
            hit = F.coalesce(hit, F.lit(False)) | (actual.try_cast("double") == float(text))
    return F.coalesce(hit, F.lit(False))


#: What a condition is made of: columns, or nodes of an index over many rules.
Conditions = Fields | AtomIndex
Condition = Column | Node


def _any(of: Conditions, parts: list) -> Condition:
    return reduce(or_, parts) if parts else of.never()


def _all(of: Conditions, parts: list) -> Condition:
    return reduce(and_, parts) if parts else of.always()


def field_matches(of: Conditions, spec: str, expected) -> Condition:
    name, *modifiers = spec.split("|")
    if not isinstance(expected, list):
        return of.one(name, expected, modifiers)
    return (_all if "all" in modifiers else _any)(of, [of.one(name, e, modifiers) for e in expected])


def selection_matches(of: Conditions, selection) -> Condition:
    """A mapping: all of its fields; a list: any of its members; a plain value: somewhere in the row."""
    if isinstance(selection, dict):
        return _all(of, [field_matches(of, k, v) for k, v in selection.items()])
    if isinstance(selection, list):
        return _any(of, [selection_matches(of, s) for s in selection])
    return of.whole(str(selection))


def compile_rule(rule: Rule, of: Conditions) -> Condition:
    """The rule as a boolean Column over a table's fields, or as a node of an index; what cannot be resolved is false."""
    named = {k.lower(): v for k, v in rule.detection.items() if k != "condition"}
    tokens = re.findall(r"\(|\)|[^\s()]+", rule.condition.lower())
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else ""

    def chosen(pattern: str) -> list:
        keys = list(named) if pattern == "them" else [k for k in named if re.fullmatch(re.escape(pattern).replace(r"\*", ".*"), k)]
        return [selection_matches(of, named[k]) for k in keys]

    def unary() -> Condition:
        t = take()
        if t == "not":
            return ~unary()
        if t == "(":
            inner = either()
            take()
            return inner
        if t in ("1", "any", "all") and peek() == "of":
            take()
            found = chosen(take())
            return of.never() if not found else _all(of, found) if t == "all" else _any(of, found)
        return selection_matches(of, named[t]) if t in named else of.never()

    def both() -> Condition:
        out = unary()
        while peek() == "and":
            take()
            out = out & unary()
        return out

    def either() -> Condition:
        out = both()
        while peek() == "or":
            take()
            out = out | both()
        return out

    return either() if tokens else of.never()


#: From so many rules on, an index finds the rules that a row can match; a few are tried one by one without leaving the JVM.
INDEXED_RULES = 64


ENTRY = "struct<rule:string,level:string,severity:string,score:int,mitre:string>"


def _described(r: Rule) -> dict:
    return {"rule": r.title, "level": r.level, "severity": LEVEL_SEVERITIES.get(r.level, "medium"), "score": LEVEL_SCORES.get(r.level, 45), "mitre": r.technique}


def scan(rows: DataFrame, rules: list[Rule], artifact: str = "", raw: str | None = None, keep: tuple[str, ...] = (), most: int | None = None, order: str | None = None, indexed: bool | None = None) -> DataFrame:
    """(keep, rule, level, severity, score, mitre) for each row and rule that match.

    Rules that don't apply to the artifact or whose fields the table lacks never reach the plan. All rules are tried
    in one pass over the rows, from INDEXED_RULES rules on through an index (`indexed` says so or not), with the same
    result. With `most`, the first rows of each rule by `order`.
    """
    fields = Fields(rows, raw)
    usable = [r for r in rules if (not artifact or r.applies_to(artifact)) and (not r.fields() or any(fields.has(f) for f in r.fields()))]
    if len(usable) >= INDEXED_RULES if indexed is None else indexed:
        index = AtomIndex(fields.get, fields.text, lambda name, value, modifiers: F.contains(F.lower(fields.text), F.lit("")) if name is None else fields.one(name, value, modifiers))
        table = F.from_json(F.lit(json.dumps([_described(r) for r in usable])), f"array<{ENTRY}>")
        out = matching(rows, index, [compile_rule(r, index) for r in usable], keep).select(*keep, F.explode("__rules").alias("__r")).select(*keep, F.get(table, F.col("__r")).alias("m")).select(*keep, "m.*")
    else:
        entry = lambda r: F.struct(*[F.lit(v).alias(k) for k, v in _described(r).items()])
        groups = [F.array_compact(F.array(*[F.when(compile_rule(r, fields), entry(r)) for r in usable[i : i + 40]])) for i in range(0, len(usable), 40)]
        out = rows.select(*keep, F.explode(F.flatten(F.array(*groups or [F.array().cast(f"array<{ENTRY}>")]))).alias("m")).select(*keep, "m.*")
    if most is not None:
        first = Window.partitionBy("rule").orderBy(order or keep[0])
        out = out.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= most).drop("__n")
    return out
