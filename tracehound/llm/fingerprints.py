"""Canonical exact fingerprints: texts that differ only in Unicode form, case or white space share one.

The canonical text is composed (NFC), lower-cased and has runs of white space folded; its fingerprint is 128 bits of
xxhash. Texts in one hash bucket are compared byte by byte, and where they differ the fingerprint gets a number.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import near, staged, text_or_empty

#: Bytes of text in one range of doc_ids, and the most ranges.
RANGE_BYTES, MOST_RANGES = 8 << 20, 65_536


@functools.cache
def _composition() -> tuple[dict[str, str], dict[str, str], dict[str, str], str, str]:
    """From the Unicode database: pairs that compose, single characters to replace by one, by several, all combining
    marks of a class other than 0, each followed by a character that sorts as the class, and the second characters of
    pairs that are of class 0."""
    pairs, single, several, classes = {}, {}, {}, []
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        if unicodedata.combining(c):
            classes.append(c + chr(0x100 + unicodedata.combining(c)))
        parts = unicodedata.decomposition(c)
        if not parts or parts.startswith("<"):
            continue
        if (whole := unicodedata.normalize("NFC", c)) != c:
            (single if len(whole) == 1 else several)[c] = whole
        elif len(parts.split()) == 2:
            pairs["".join(chr(int(x, 16)) for x in parts.split())] = c
    return pairs, single, several, "".join(classes), "".join(sorted({p[1] for p in pairs if not unicodedata.combining(p[1])}))


def _literal_map(d: dict[str, str]) -> Column:
    """One literal, which Catalyst folds once."""
    return F.from_json(F.lit(json.dumps(d)), "map<string,string>")


def _runs(characters: str) -> str:
    """A regular expression's class members for these characters, as ranges."""
    codes, out = sorted(set(map(ord, characters))), []
    for code in codes:
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


def _compose(text: Column) -> Column:
    """Canonical composition of a text that may hold combining marks, conjoining jamo or excluded characters."""
    pairs, _, several, classes, seconds = _composition()
    class_of = lambda c: F.translate(c, classes[::2], classes[1::2])
    clusters = F.regexp_extract_all(text, F.lit(f"(?s)[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?|[가-힣][ᆨ-ᇂ]|.[{_runs(seconds)}]*[\\p{{M}}&&[{_runs(classes[::2])}]]*"), F.lit(0))
    number = lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")
    at = lambda c, i: F.substring(c, i, 1)
    tail = lambda c, i: F.when(F.char_length(c) >= i, number(at(c, i)) - 0x11A7).otherwise(0)
    closed = lambda c: (number(at(c, 1)) >= 0xAC00) & ((number(at(c, 1)) - 0xAC00) % 28 != 0)
    syllable = lambda c: F.when(closed(c), c).otherwise(F.decode(F.unhex(F.hex(F.when(number(at(c, 1)) < 0xAC00, 0xAC00 + ((number(at(c, 1)) - 0x1100) * 21 + number(at(c, 2)) - 0x1161) * 28 + tail(c, 3)).otherwise(number(at(c, 1)) + tail(c, 2)))), "UTF-16BE"))

    pair_map = _literal_map(pairs)
    apart_map = _literal_map({c: unicodedata.normalize("NFD", c) for c in several} | {c: unicodedata.normalize("NFD", c) for c in pairs.values()})

    def marks(cluster: Column) -> Column:
        apart = F.array_join(F.transform(F.split(cluster, ""), lambda c: F.coalesce(F.try_element_at(apart_map, c), c)), "")
        base, rest = at(apart, 1), F.filter(F.split(F.substring(apart, F.lit(2), F.char_length(apart)), ""), lambda c: c != "")
        keyed = F.transform(rest, lambda c, i: F.struct(F.when(class_of(c) == c, F.lit("")).otherwise(class_of(c)).alias("k"), i.alias("i"), c.alias("c")))
        ordered = F.array_sort(keyed)
        begin = F.struct(base.alias("base"), F.lit("").alias("rest"), F.lit("").alias("k"))

        def step(state: Column, m: Column) -> Column:
            whole = F.try_element_at(pair_map, F.concat(state["base"], m["c"]))
            joined = whole.isNotNull() & ((state["rest"] == "") | ((state["k"] < m["k"]) & (state["k"] != "")))
            return F.struct(F.when(joined, whole).otherwise(state["base"]).alias("base"), F.when(joined, state["rest"]).otherwise(F.concat(state["rest"], m["c"])).alias("rest"), F.when(joined, state["k"]).otherwise(m["k"]).alias("k"))

        return F.aggregate(ordered, begin, step, lambda s: F.concat(s["base"], s["rest"]))

    one = lambda c: F.when((F.char_length(c) == 1) & ~c.rlike("[" + _runs("".join(several)) + "]"), c).when(c.rlike(r"^[ᄀ-ᄒ가-힣]") & (F.char_length(c) > 1) & c.rlike(r"^.[ᅡ-ᅵᆨ-ᇂ]"), syllable(c)).otherwise(marks(c))
    return F.array_join(F.transform(clusters, one), "")


def canonical_text(text: Column) -> Column:
    """The text composed (NFC), lower-cased with sharp s as ss, white space runs as one space and none at the ends."""
    _, single, several, _, _ = _composition()
    text = text_or_empty(text)
    # Everything that composition changes lies from U+0300 on.
    plain = F.translate(text, "".join(single), "".join(single.values()))
    odd = "[\\p{M}ᅡ-ᅵᆨ-ᇂ" + _runs("".join(several)) + "]"
    composed = F.when(~text.rlike(r"[^\x00-\x{2FF}]"), text).when(plain.rlike(odd), _compose(F.concat(F.lit(" "), plain))).otherwise(plain)
    folded = F.replace(F.replace(F.lower(composed), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.trim(F.regexp_replace(folded, r"[\s\x1C-\x1F\x85\p{Z}]+", " "))


def wide_hash(canonical: Column) -> Column:
    """Two 64-bit xxhashes as 32 hexadecimal digits."""
    digits = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(canonical, F.lit(seed)))), 16, "0")
    return F.concat(digits(11), digits(29))


def collisions(texts: DataFrame) -> DataFrame:
    """(fingerprint, check, number) of the canonical texts that share a hash with another; texts(fingerprint, canonical).

    The grouping by hash and bytes folds copies before the shuffle, so a text that stands in a third of all rows is
    one row a task. check is a SHA-256 that stands for the bytes from here on.
    """
    distinct = texts.groupBy("fingerprint", "canonical").agg(F.lit(1).alias("one"))
    keyed = distinct.select("fingerprint", F.sha2("canonical", 256).alias("check"))
    shared = keyed.groupBy("fingerprint").agg(F.collect_list("check").alias("checks")).filter(F.size("checks") > 1)
    return shared.select("fingerprint", F.posexplode(F.array_sort("checks")).alias("number", "check")).filter("number > 0")


def fingerprint_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns + fingerprint for each row of docs(text, ...).

    Equal canonical texts, equal fingerprints, and different ones differ: 32 digits, and -n where n texts of lower
    SHA-256 have the same hash. Null texts count as empty. Every row, repeated ones too, gets its fingerprint; empty
    tables give none.
    """
    rows = docs.select(*keep, canonical_text(F.col("text")).alias("canonical")).withColumn("fingerprint", wide_hash(F.col("canonical")))
    return numbered(rows.withColumn("check", F.sha2("canonical", 256)).drop("canonical"), [rows], {"fingerprint": "check"}).drop("check")


def numbered(rows: DataFrame, texts: list[DataFrame], checks: dict[str, str], fingerprints: list[DataFrame] | None = None) -> DataFrame:
    """rows with the numbers of collided texts put to their fingerprints.

    texts: tables of (fingerprint, canonical), which together hold every text that rows has a fingerprint of; checks:
    fingerprint column -> check column; fingerprints: those of texts, where they are already made. Bytes are compared
    within buckets of two rows or more, so that only these are moved.
    """
    tables = fingerprints or texts
    buckets = tables[0].select("fingerprint")
    for more in tables[1:]:
        buckets = buckets.unionByName(more.select("fingerprint"))
    shared = staged(buckets.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint"), "fingerprint-shared")
    sent = near(shared, shared.count())
    held = [t.select("fingerprint", "canonical").join(sent, "fingerprint", "left_semi") for t in texts]
    found = held[0]
    for more in held[1:]:
        found = found.unionByName(more)
    found = staged(collisions(found), "fingerprint-collisions")
    if not found.head(1):
        return rows
    for name, check in checks.items():
        own = found.select(F.col("fingerprint").alias("__f"), F.col("check").alias("__c"), "number")
        rows = rows.join(own, (F.col(name) == F.col("__f")) & (F.col(check) == F.col("__c")), "left")
        rows = rows.withColumn(name, F.concat_ws("-", name, F.col("number").cast("string"))).drop("__f", "__c", "number")
    return rows


def with_next(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """docs(doc_id, text, tie, ...) with next_<c> for each of columns: from the next row by doc_id (ties: by tie,
    null first), after the last from the first.

    The ids are cut into ranges of even size by quantiles; a row that begins a range also goes, marked, to the range
    before, so the text moves once and no range waits for another.
    """
    spark = docs.sparkSession
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if n == 0:
        return docs.withColumns({f"next_{c}": F.col(c) for c in columns})
    ranges = min(MOST_RANGES, n, max(1, -(-(size or 0) // RANGE_BYTES)))
    at = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    cuts = docs.select(F.percentile_approx(at, [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges)).alias("q")).first()["q"] if ranges > 1 else []
    inner = sorted({c for c in cuts or [] if c != float("-inf")})
    split = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="__at", outputCol="__range", handleInvalid="keep") if inner else None
    rows = docs.withColumn("__at", at)
    rows = split.transform(rows).drop("__at") if split else rows.withColumn("__range", F.lit(0.0)).drop("__at")
    rows = rows.withColumn("__range", F.col("__range").cast("int"))
    # At most MOST_RANGES rows: the first row of each range, and the range before it that has rows.
    heads = rows.groupBy("__range").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), "tie")).alias("head"))
    heads = sorted((r["__range"], r["head"]["d"], r["head"]["tie"]) for r in heads.collect())
    back = [(r, d, tie, heads[i - 1][0]) for i, (r, d, tie) in enumerate(heads)]
    back = F.broadcast(spark.createDataFrame(back, "__r int, __d long, __t long, __back int"))
    is_head = (F.col("__range") == F.col("__r")) & (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("__d")) & (F.col("tie") == F.col("__t"))
    rows = rows.join(back, is_head, "left").drop("__r", "__d", "__t")
    places = F.when(F.col("__back").isNull(), F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("m"))))
    places = places.otherwise(F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("m")), F.struct(F.col("__back").alias("r"), F.lit(True).alias("m"))))
    rows = rows.withColumn("__place", F.explode(places)).withColumns({"__range": F.col("__place.r"), "__marked": F.col("__place.m")}).drop("__place", "__back")
    order = Window.partitionBy("__range").orderBy("__marked", "doc_id", "tie")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return rows.filter(~F.col("__marked")).drop("__range", "__marked")
