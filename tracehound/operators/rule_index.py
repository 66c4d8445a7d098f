"""Thousands of event rules over rows in one pass: an index from literals to the rules that need them.

All conditions of all rules are atoms (field, kind, value). One automaton tells which literal atoms hold for a row; a rule is
looked at only where an atom holds without which it cannot match, and then its condition, a short program over atoms, is
run. So a row's work follows what it holds and not the number of rules, and the plan's size does not grow with them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.literals import Literal, is_set, literal_hits
from tracehound.functions.signatures import gates

#: Steps of a program besides atoms, which are numbers from 0.
AND, OR, NOT, TRUE, FALSE = -1, -2, -3, -4, -5
#: Kinds of atoms that the automaton tells: parts of a text, and all of it or a number.
PARTS = ("contains", "startswith", "endswith")
LITERALS = (*PARTS, "equals", "number")
#: A program's stack is the bits of one number.
MOST_NESTED = 60


class Node:
    """A condition: its program, its depth, and atoms of which one holds wherever it does (None: not to be told)."""

    def __init__(self, program: list[int], depth: int, triggers: frozenset[int] | None, index: AtomIndex):
        self.program, self.depth, self.triggers, self.index = program, depth, triggers, index

    def __and__(self, other: Node) -> Node:
        some = [t for t in (self.triggers, other.triggers) if t is not None]
        return self._joined(other, AND, max(some, key=self.index.rarity, default=None))

    def __or__(self, other: Node) -> Node:
        some = None if self.triggers is None or other.triggers is None else self.triggers | other.triggers
        return self._joined(other, OR, some)

    def __invert__(self) -> Node:
        return Node([*self.program, NOT], self.depth, None, self.index)

    def _joined(self, other: Node, step: int, triggers: frozenset[int] | None) -> Node:
        return Node([*self.program, *other.program, step], max(self.depth, other.depth + 1), triggers, self.index)


class AtomIndex:
    """Collects the atoms of rules. It stands where a rule's compiler expects a table's fields, and gives nodes for columns."""

    def __init__(self, get: Callable[[str], Column], text: Column, direct: Callable[[str, object, list[str]], Column]):
        self.get, self.text, self.direct = get, text, direct
        self.atoms: dict[tuple, int] = {}

    def _atom(self, *key) -> Node:
        id_ = self.atoms.setdefault(key, len(self.atoms))
        return Node([id_], 1, frozenset([id_]), self)

    def rarity(self, triggers: frozenset[int]) -> int:
        """How seldom some of these atoms should hold: by the least telling one."""
        keys = list(self.atoms)
        return min((len(keys[t][2]) + 4 * (keys[t][0] == "equals") if keys[t][0] in ("contains", "startswith", "endswith", "equals", "regex") else 0 for t in triggers), default=99)

    def never(self) -> Node:
        return Node([FALSE], 1, frozenset(), self)

    def always(self) -> Node:
        return Node([TRUE], 1, None, self)

    def whole(self, value: str) -> Node:
        """The value somewhere in the row."""
        return self._atom("contains", None, value.lower()) if value else self._atom("direct", None, "", ())

    def one(self, name: str, expected, modifiers: list[str]) -> Node:
        """A field against one value, as rules._one has it for columns."""
        if expected is None or "cidr" in modifiers:
            return self._atom("direct", name, expected if expected is None else str(expected), tuple(modifiers))
        text = str(expected)
        low = text.lower().replace("\\", "/")
        if "re" in modifiers:
            return self._atom("regex", name, text)
        kind = next((k for k in ("contains", "startswith", "endswith") if k in modifiers), None)
        if kind and not low:
            return self._atom("direct", name, text, tuple(modifiers))
        if kind == "contains" and "windash" in modifiers and "-" in low:
            return self._atom(kind, name, low) | self._atom(kind, name, low.replace("-", "/"))
        if kind:
            return self._atom(kind, name, low)
        same = self._atom("equals", name, text.lower())
        return same | self._atom("number", name, float(text)) if re.fullmatch(r"-?\d+(\.\d+)?", text) else same


def _literal(value: list, kind: str) -> Column:
    """A table that the plan holds as one value."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _holds(program: Column, bits: Column, literals: int, others: Column) -> Column:
    """Whether a program ends in true: atoms are pushed, NOT turns the last bit, AND and OR take the last two. Of the atoms the
    first are literals, looked up by bit; of the few others that hold there is a list."""

    def step(stack: Column, x: Column) -> Column:
        last, before, rest = stack.bitwiseAND(F.lit(1)), F.shiftright(stack, 1).bitwiseAND(F.lit(1)), F.shiftright(stack, 2)
        push = lambda bit: F.shiftleft(stack, 1) + bit
        pop = lambda bit: F.shiftleft(rest, 1) + bit
        held = F.when(x < literals, is_set(bits, x)).otherwise(F.array_contains(others, x).cast("long"))
        out = F.when(x >= 0, push(held)).when(x == AND, pop(last.bitwiseAND(before))).when(x == OR, pop(last.bitwiseOR(before)))
        return out.when(x == NOT, stack.bitwiseXOR(F.lit(1))).when(x == TRUE, push(F.lit(1))).otherwise(push(F.lit(0))).cast("long")

    return F.aggregate(program, F.lit(0).cast("long"), step).bitwiseAND(F.lit(1)) == 1


def matching(rows: DataFrame, index: AtomIndex, conditions: list[Node], keep: tuple[str, ...]) -> DataFrame:
    """keep + __rules, array<int>: the numbers of the conditions that hold for each row, in order."""
    if any(c.depth > MOST_NESTED for c in conditions):
        raise ValueError(f"a condition is nested more than {MOST_NESTED} deep")
    # A regular expression is tried only where a literal stands that its matches must hold.
    expressions = []
    for (kind, name, *rest), id_ in list(index.atoms.items()):
        if kind == "regex":
            own = [index._atom("contains", name, g.replace("\\", "/")).program[0] for g in gates(rest[0])]
            expressions.append((id_, name, rest[0], own))
    # Atoms that are literals are numbered first.
    keys = sorted(index.atoms, key=lambda key: (key[0] not in LITERALS, index.atoms[key]))
    number = {index.atoms[key]: i for i, key in enumerate(keys)}
    n_literals = sum(key[0] in LITERALS for key in keys)
    fields = list(dict.fromkeys(key[1] for key in keys if key[0] != "direct"))
    values = {name: index.text if name is None else index.get(name) for name in fields}
    raw = {f"__v{i}": values[name] for i, name in enumerate(fields)}
    place = {name: i for i, name in enumerate(fields)}
    # Each field is a text as the kinds compare it: with one kind of slash for parts, as it is for the whole row and for wholes.
    n = len(fields)
    literals = []
    for id_, (kind, name, *rest) in enumerate(keys[:n_literals]):
        literals.append(Literal(id_, kind, place[name] + (n if kind in PARTS and name is not None else 0), rest[0]))
    low = [F.lower(F.col(f"__v{i}")) for i in range(n)]
    texts = [*low, *[F.translate(x, "\\", "/") for x in low]]
    numeric = {key[1] for key in keys if key[0] == "number"}
    numbers = [F.col(f"__v{i}").try_cast("double") if name in numeric else F.lit(None).cast("double") for i, name in enumerate(fields)]
    direct = [(id_, index.direct(name, value, list(modifiers))) for id_, (kind, name, *rest) in enumerate(keys) if kind == "direct" for value, modifiers in [rest]]
    rows = rows.select(*keep, *[v.alias(k) for k, v in raw.items()], *[condition.alias(f"__d{id_}") for id_, condition in direct])
    others = F.array_compact(F.array(*[F.when(F.col(f"__d{id_}"), id_) for id_, _ in direct])) if direct else F.array()
    rows = rows.withColumn("__h", literal_hits(texts, literals, numbers)).withColumn("__others", others.cast("array<int>"))
    if expressions:
        postings: list[list[int]] = [[] for _ in keys]
        free = []
        for k, (_, _, _, own) in enumerate(expressions):
            for g in own:
                postings[number[g]].append(k)
            if not own:
                free.append(k)
        tried = F.array_distinct(F.concat(_literal(free, "array<int>"), F.flatten(F.transform("__h.ids", lambda h: F.get(_literal(postings, "array<array<int>>"), h)))))
        table = _literal([{"id": number[id_], "field": place[name], "pattern": f"(?i){pattern}"} for id_, name, pattern, _ in expressions], "array<struct<id:int,field:int,pattern:string>>")
        texts_ = F.array(*[F.col(f"__v{i}") for i in range(n)])
        rows = rows.withColumn("__values", texts_).withColumn("__tried", tried)
        hit = lambda k: F.coalesce(F.regexp_like(F.get(F.col("__values"), F.get(table, k)["field"]), F.get(table, k)["pattern"]), F.lit(False))
        rows = rows.withColumn("__others", F.concat("__others", F.transform(F.filter("__tried", hit), lambda k: F.get(table, k)["id"])))
    by_atom: list[list[int]] = [[] for _ in keys]
    always = []
    for r, condition in enumerate(conditions):
        if condition.triggers is None:
            always.append(r)
        for t in condition.triggers or ():
            by_atom[number[t]].append(r)
    looked_at = F.array_distinct(F.concat(_literal(always, "array<int>"), F.flatten(F.transform(F.concat("__h.ids", "__others"), lambda h: F.get(_literal(by_atom, "array<array<int>>"), h)))))
    rows = rows.withColumn("__looked_at", looked_at).withColumn("__bits", F.col("__h.bits"))
    programs = _literal([[number[x] if x >= 0 else x for x in c.program] for c in conditions], "array<array<int>>")
    return rows.select(*keep, F.array_sort(F.filter("__looked_at", lambda r: _holds(F.get(programs, r), F.col("__bits"), n_literals, F.col("__others")))).alias("__rules"))
