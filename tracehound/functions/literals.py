"""Many literals looked for in many texts at once, by one automaton (Aho-Corasick) that reads each text once."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HITS = "ids array<int>, bits array<bigint>"


class Literal(NamedTuple):
    """A literal in the text of number `source`: anywhere (contains), at its start or end (startswith, endswith) or all of it
    (equals); or a value that the number of number `source` has (number)."""

    id: int
    kind: str
    source: int
    value: str | float


class Automaton:
    """The ids of the literals that a row's texts hold."""

    def __init__(self, literals: list[Literal]):
        self.whole: dict[tuple[int, str], list[int]] = {}
        self.numbers: dict[tuple[int, float], list[int]] = {}
        self.sources: dict[int, ahocorasick.Automaton] = {}
        parts: dict[int, dict[str, list[tuple[str, int]]]] = {}
        for x in literals:
            if x.kind in ("equals", "number"):
                (self.whole if x.kind == "equals" else self.numbers).setdefault((x.source, x.value), []).append(x.id)
            else:
                parts.setdefault(x.source, {}).setdefault(x.value, []).append((x.kind, x.id))
        for source, texts in parts.items():
            found = ahocorasick.Automaton()
            for text, uses in texts.items():
                found.add_word(text, (len(text), uses))
            found.make_automaton()
            self.sources[source] = found

    def find(self, texts: list[str | None], numbers: list[float | None]) -> list[int]:
        out: set[int] = set()
        for source, number in enumerate(numbers):
            out.update(self.numbers.get((source, number), ()))
        for source, text in enumerate(texts):
            if text is None:
                continue
            out.update(self.whole.get((source, text), ()))
            if source in self.sources:
                last = len(text) - 1
                for end, (length, uses) in self.sources[source].iter(text):
                    for kind, id_ in uses:
                        if kind == "contains" or (kind == "startswith" and end == length - 1) or (kind == "endswith" and end == last):
                            out.add(id_)
        return sorted(out)


#: Bits in a word of the bit field of hits.
WORD = 64


def is_set(bits: Column, id_: Column) -> Column:
    """1 or 0: whether the bit of a number is set in array<bigint> bits."""
    word = F.get(bits, F.call_function("shiftright", id_, F.lit(6)))
    return F.call_function("shiftright", word, id_.bitwiseAND(F.lit(WORD - 1))).bitwiseAND(F.lit(1))


def literal_hits(texts: list[Column], literals: list[Literal], numbers: list[Column] | None = None) -> Column:
    """struct<ids: array<int>, bits: array<bigint>>: the literals that hold for a row, whose texts and numbers are given by
    source, as their ids and as a field of bits by id; null holds none.

    Texts and literals are compared as they are: lower-case both for a search in any case. The automaton is made once
    in each task and its size is that of the literals; each text is read once, however many literals there are.
    """

    words = 1 + max((x.id for x in literals), default=0) // WORD

    @F.arrow_udf(HITS)
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        automaton = Automaton(literals)
        for rows, values in batches:
            # One row's texts at a time; what a batch has found is held as numbers side by side, not as objects.
            ids, ends, bits = array("i"), array("i", [0]), np.zeros((len(rows), words), dtype=np.uint64)
            for i, (row, own) in enumerate(zip(rows, values)):
                found = automaton.find(row.as_py(), own.as_py())
                ids.extend(found)
                ends.append(len(ids))
                at = np.array(found, dtype=np.int64)
                np.bitwise_or.at(bits[i], at // WORD, np.uint64(1) << (at % WORD).astype(np.uint64))
            places = np.arange(len(rows) + 1, dtype=np.int32) * words
            lists = pa.ListArray.from_arrays(np.array(ends, dtype=np.int32), np.array(ids, dtype=np.int32)), pa.ListArray.from_arrays(places, bits.view(np.int64).ravel())
            yield pa.StructArray.from_arrays(lists, names=["ids", "bits"])

    if not literals:
        return F.struct(F.array().cast("array<int>").alias("ids"), F.array(F.lit(0).cast("bigint")).alias("bits"))
    # Texts that no literal is looked for in stay where they are.
    used = {x.source for x in literals if x.kind != "number"}
    texts = [text if source in used else F.lit(None) for source, text in enumerate(texts)]
    return find(F.array(*texts).cast("array<string>"), F.array(*(numbers or [])).cast("array<double>"))


@lru_cache(maxsize=64)
def _held(groups: tuple[tuple[str, ...], ...]):
    """The function of groups_held(); the same one for the same groups, so that a plan that asks twice runs it once."""

    @F.arrow_udf("array<int>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        leads: dict[str, list[int]] = {}
        for i, literals in enumerate(groups):
            for literal in literals:
                leads.setdefault(literal, []).append(i)
        automaton = ahocorasick.Automaton()
        for literal, led in leads.items():
            automaton.add_word(literal, led)
        automaton.make_automaton()
        for texts in batches:
            # One text at a time, so that no more of a batch than its Arrow form is held.
            found = (sorted({i for _, led in automaton.iter(text.as_py().lower()) for i in led}) if text.is_valid else () for text in texts)
            yield pa.array(found, pa.list_(pa.int32()), size=len(texts))

    return find


def groups_held(text: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """array<int>: the groups of lower-case literals, by number and in order, of which a text holds one at least, in any case."""
    return _held(groups)(text)
