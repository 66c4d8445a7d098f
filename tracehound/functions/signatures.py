"""Signature tables applied to a text: all matches, the first, or the first of a least length."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import groups_held
from .scalars import severity_rank
from .tables import COMMAND_SIGNATURES, PATH_SIGNATURES, WINDOWS_ROOT_NAMES

Signature = tuple[str, str, str]  # pattern, label, severity


ROWS = "array<struct<n:int,label:string,severity:string,pattern:string>>"
#: The least length of a literal that stands in front of a pattern: of letters only, and with another character.
LEAST_GATE, LEAST_ODD_GATE = 3, 2


def _strength(literal: str) -> int:
    """How telling a literal is; 0 if it is too short to stand in front of a pattern."""
    odd = not literal.isalpha()
    return len(literal) + odd if len(literal) >= (LEAST_ODD_GATE if odd else LEAST_GATE) else 0


def _closing(pattern: str, start: int) -> int:
    """The place of the bracket that closes the group that begins at start."""
    depth, i = 0, start
    while True:
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.index("]", i + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i
        i += 1


def gates(pattern: str) -> list[str]:
    """Lower-case literals of which a text that the pattern matches holds one at least; none if that is not to be told.

    Of each alternative the longest run of plain characters that no quantifier makes optional, outside classes, or the
    literals of a group that is not optional, if the least of these tells more.
    """
    alternatives, parts, run, i = [], [], "", 0

    def close() -> None:
        nonlocal run
        parts.append([run])
        run = ""

    def best() -> list[str]:
        return max(parts, key=lambda p: min(map(_strength, p)))

    while i < len(pattern):
        c, step = pattern[i], 1
        if c == "\\":
            step = 2
            c = pattern[i + 1] if not pattern[i + 1].isalnum() else ""
        elif c == "[":
            step, c = pattern.index("]", i + 2) + 1 - i, ""
        elif c == "(":
            end = _closing(pattern, i)
            inner = pattern[i + 1 : end].removeprefix("?:")
            close()
            if not inner.startswith("?") and pattern[end + 1 : end + 2] not in ("?", "*", "{") and (own := gates(inner)):
                parts.append(own)
            step, c = end + 1 - i, ""
        elif c == "|":
            close()
            alternatives.append(best())
            parts, c = [], None
        elif c in ".^$?*+{":
            if c in "?*{":
                run = run[:-1]
            step, c = (pattern.index("}", i) + 1 - i, "") if c == "{" else (1, "")
        i += step
        if c is None:
            continue
        if c:
            run += c.lower()
        else:
            close()
    close()
    alternatives.append(best())
    return [g for own in alternatives for g in own] if all(map(_strength, (g for own in alternatives for g in own))) else []


def _literal(value: list | dict, kind: str) -> Column:
    """A table as one literal, which Catalyst folds once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


#: Literals from which on one automaton tells which stand in a text, where each is looked for by itself otherwise.
MANY_LITERALS = 20


def all_matches(text: Column, table: tuple[Signature, ...] = COMMAND_SIGNATURES, least: int = 0) -> Column:
    """array<struct<n, label, severity, pattern>> of the signatures found in the text, in table order.

    With `least`, a signature counts only if its first match has that many characters. A pattern is tried only where the
    text holds a literal that its matches must hold, and few texts do; many literals are told by one automaton that reads
    a text once, whatever their number. Patterns without such literals are constants of the plan, compiled once.
    """
    patterns = [f"(?i){pattern}" for pattern, _, _ in table]
    own = [tuple(gates(pattern)) for pattern, _, _ in table]
    gated = [n for n, literals in enumerate(own) if literals]
    rows = _literal([{"n": n, "label": label, "severity": severity, "pattern": patterns[n]} for n, (_, label, severity) in enumerate(table)], ROWS)

    def hit(pattern: Column) -> Column:
        found = F.regexp_like(text, pattern)
        return found & (F.char_length(F.call_function("regexp_extract", text, pattern, F.lit(0))) >= least) if least else found

    if len({g for literals in own for g in literals}) >= MANY_LITERALS:
        tried = groups_held(text, tuple(own))
    else:
        parts = _literal([{"n": n, "gates": own[n]} for n in gated], "array<struct<n:int,gates:array<string>>>")
        tried = F.get(F.transform(F.array(F.lower(text)), lambda low: F.transform(F.filter(parts, lambda s: F.exists(s["gates"], lambda g: F.contains(low, g))), lambda s: s["n"])), 0)
    found = F.filter(tried, lambda n: hit(F.get(_literal(patterns, "array<string>"), n)))
    if len(gated) < len(table):
        free = F.array(*[F.when(hit(F.lit(patterns[n])), n) for n, literals in enumerate(own) if not literals])
        found = F.array_sort(F.concat(found, F.array_compact(free.cast("array<int>"))))
    return F.transform(found, lambda n: F.get(rows, n))


def first_match(text: Column, table: tuple[Signature, ...] = COMMAND_SIGNATURES, least: int = 0, among: tuple[str, ...] = ()) -> Column:
    """The first signature found (among severities, if given); null if none."""
    chosen = tuple(s for s in table if not among or s[2] in among)
    return F.try_element_at(all_matches(text, chosen, least), F.lit(1))


def path_matches(path: Column, name: Column | None = None) -> Column:
    """Suspicious places of a path; the rule for the Windows folder itself spares programs that belong there."""
    found = all_matches(path, PATH_SIGNATURES)
    if name is None:
        return found
    spared = F.lower(F.coalesce(name, F.lit(""))).isin(*WINDOWS_ROOT_NAMES)
    return F.filter(found, lambda m: ~(spared & (m["n"] == len(PATH_SIGNATURES) - 1)))


def at_least(match: Column, severity: str = "medium") -> Column:
    return severity_rank(match["severity"]) <= ("critical", "high", "medium", "low", "info").index(severity)
