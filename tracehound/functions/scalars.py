"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import DGA_EXEMPT_DOMAINS

SEVERITIES = ("critical", "high", "medium", "low", "info")
#: Formats of timestamps without their zone, most exact first.
TIMESTAMP_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss", "MM/dd/yyyy h:mm:ss a")
#: Words in a message that give its severity, first group first.
SEVERITY_WORDS = {
    "critical": "critical|emerg|alert|crit",
    "high": "error|err|fail|denied|refused|attack|exploit|malware|trojan|rootkit|injection|shell|exec",
    "medium": "warn|warning|notice|suspicious|invalid|blocked|drop|reject",
}
IPV4 = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
DGA_LABEL, DGA_ENTROPY, DGA_VOWELS, DGA_CONSONANTS = 12, 3.6, 0.25, 5


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern is found, without regard to case; null texts don't match."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def alias(row: Column, *names: str, keep_empty: bool = False) -> Column:
    """The first of a map's fields that is there and not empty; the empty string if none is.

    The fields are looked up in an array, whose function is no part of generated code: a lookup is a loop there, and a
    family's lookups would make one method that is too long for the JVM to compile.
    """
    held = F.filter(F.array(*[row[n] for n in names]), lambda v: v.isNotNull() if keep_empty else v != "")
    return F.coalesce(F.get(held, 0), F.lit(""))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars, n = F.filter(F.split(text, ""), lambda c: c != ""), F.char_length(text)

    def part(c: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == c)) / n
        return -p * F.log2(p)

    return F.when(n > 0, F.aggregate(F.transform(F.array_distinct(chars), part), F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))


def consonant_run(text: Column) -> Column:
    """Length of the longest run of consonants."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("([b-df-hj-np-tv-z]+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.char_length)), F.lit(0))


def vowel_ratio(text: Column) -> Column:
    """Vowels among the letters."""
    letters = F.regexp_replace(F.lower(text), "[^a-z]", "")
    return F.when(F.char_length(letters) > 0, F.char_length(F.regexp_replace(letters, "[^aeiou]", "")) / F.char_length(letters)).otherwise(F.lit(0.0))


def digit_ratio(text: Column) -> Column:
    return F.when(F.char_length(text) > 0, F.char_length(F.regexp_replace(text, "[^0-9]", "")) / F.char_length(text)).otherwise(F.lit(0.0))


def looks_generated(label: Column) -> Column:
    """Two of three signs of a generated name: entropy, few vowels, a long run of consonants; long labels only."""
    letters = F.char_length(F.regexp_replace(F.lower(label), "[^a-z]", ""))
    signs = (entropy(F.lower(label)) >= DGA_ENTROPY).cast("int") + (vowel_ratio(label) <= DGA_VOWELS).cast("int") + (consonant_run(label) >= DGA_CONSONANTS).cast("int")
    return F.coalesce((F.char_length(label) >= DGA_LABEL) & (letters >= DGA_LABEL * 0.6) & (signs >= 2), F.lit(False))


def registered_domain(name: Column) -> Column:
    """The last two labels, lower-cased."""
    return F.substring_index(F.regexp_replace(F.lower(name), r"^\.+|\.+$", ""), ".", -2)


def exempt_domain(name: Column) -> Column:
    return registered_domain(name).isin(*DGA_EXEMPT_DOMAINS)


def base_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "/", "\\"), "\\", -1)


def parent_folder(path: Column) -> Column:
    """Everything before the last separator, lower-cased, with backslashes."""
    p = F.translate(F.lower(path), "/", "\\")
    return F.regexp_extract(p, r"^(.*)\\[^\\]*$", 1)


#: Path segments that name no tool.
GENERIC_SEGMENTS = ("users", "windows", "system", "programfiles", "programdata", "appdata", "local", "roaming", "temp", "downloads", "desktop", "documents", "public", "program", "files", "default")


def tool_token(path: Column) -> Column:
    """The first folder whose letters, five at least, are no generic name; null if none."""
    folders = F.split(F.translate(F.lower(path), "/", "\\"), r"\\")
    names = F.transform(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), lambda s: F.regexp_replace(s, "[^a-z]", ""))
    return F.try_element_at(F.filter(names, lambda s: (F.char_length(s) >= 5) & ~s.isin(*GENERIC_SEGMENTS)), F.lit(1))


def ipv4(text: Column) -> Column:
    """The first dotted quad; null if none."""
    return F.nullif(F.regexp_extract(text, IPV4, 1), F.lit(""))


def port(address: Column) -> Column:
    return F.regexp_extract(address, r":(\d+)$", 1).try_cast("int")


def without_port(address: Column) -> Column:
    return F.regexp_replace(address, r":\d+$", "")


def double_extension(name: Column) -> Column:
    return matches(name, r"\.(pdf|docx?|xlsx?|pptx?|jpe?g|png|gif|txt|zip|rar|html?)\.(exe|scr|bat|cmd|com|pif|js|vbs|ps1|hta|lnk)$")


def percent_decoded(path: Column) -> Column:
    """%xx decoded; a plus sign stays."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info; anything else counts as medium."""
    out = F.when(F.lower(severity) == SEVERITIES[0], 0)
    for i, s in enumerate(SEVERITIES[1:], 1):
        out = out.when(F.lower(severity) == s, i)
    return out.otherwise(2)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def severity_of(message: Column) -> Column:
    """Severity by the words of a message."""
    out = None
    for severity, words in SEVERITY_WORDS.items():
        out = (F if out is None else out).when(F.lower(message).rlike(words), severity)
    return out.otherwise("low")


def parse_time(text: Column, formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> Column:
    """TIMESTAMP_NTZ in UTC of a text in one of the formats; an offset is applied, null if nothing fits."""
    offset = F.regexp_extract(text, r"([+-]\d{2}):?(\d{2})$", 0)
    plain = F.trim(F.regexp_replace(text, r"\s*([+-]\d{2}:?\d{2}|Z|UTC)$", ""))
    tried = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in formats]).cast("timestamp_ntz")
    part = lambda i: F.regexp_extract(text, r"[+-](\d{2}):?(\d{2})$", i).try_cast("int")
    minutes = F.when(offset.startswith("-"), -1).otherwise(1) * (part(1) * 60 + part(2))
    return F.when(offset == "", tried).otherwise(tried - F.make_dt_interval(mins=minutes))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors over the length that both have; 0 if one has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(size > 0, dot(x, y) / size).otherwise(F.lit(0.0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)
