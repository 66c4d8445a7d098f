"""Byte-pair vocabularies of the `tokenizers` JSON format with word ends: reading, word splitting and merging."""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
import re
from collections.abc import Iterator

import numpy as np
import regex

#: Characters of a text that are normalised and split at a time.
PIECE = 1 << 16
#: Unicode white space, as the format's \s has it.
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"

#: Letters and digits that Unicode has had since after version 16, which the library's database is of.
LATER = [
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]

#: Capitals that the standard library's database does not have yet, and their small letters.
LATER_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
LATER_CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Any character from the first of them on, which few texts hold.
_LATER_CAPITAL = re.compile(f"[{chr(min(LATER_CAPITALS))}-\U0010FFFF]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 characters for themselves, the others from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Vocabulary:
    """One vocabulary file. Pairs are held as first * size + second -> rank * size + merged."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        ids, merges = model["vocab"], model["merges"]
        self.size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.strings = [""] * self.size
        for text, i in ids.items():
            self.strings[i] = text
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.strings[i] = text
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + self.suffix] for c in letters]
        self.bytes_of = {c: b for b, c in enumerate(letters)}
        size = self.size
        self.pairs, self.parts = {}, {}
        for rank, (a, b) in enumerate(merges):
            self.pairs[ids[a] * size + ids[b]] = rank * size + ids[a + b]
            self.parts.setdefault(ids[a + b], (ids[a], ids[b], rank))
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in merges]
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.ascii_words = regex.compile(pattern.replace(r"\s", SPACE))
        later = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in LATER)
        letter, digit = rf"[\p{{L}}--[{later}]]", rf"[\p{{N}}--[{later}]]"
        pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^{SPACE}\p{{L}}\p{{N}}]|[{later}])").replace(r"[\p{L}]", letter).replace(r"[\p{N}]", digit)
        self.words = regex.compile("(?V1)" + pattern)
        self.decoder = spec["decoder"]
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.hint = next(iter(self.special))[:2] if self.special else ""

    def split(self, text: str) -> Iterator[str]:
        """The words of a normalised text, one by one."""
        return (m.group() for m in (self.ascii_words if text.isascii() else self.words).finditer(text))

    def pieces(self, text: str) -> Iterator[str]:
        """A text in pieces that end before a space, each of PIECE characters if it has spaces: neither words nor
        special strings nor composed characters reach over one."""
        start = 0
        while len(text) - start > PIECE:
            end = text.rfind(" ", start + 1, start + PIECE)
            end = text.find(" ", start + PIECE) if end < 0 else end
            if end < 0:
                break
            yield text[start:end]
            start = end
        yield text[start:] if start else text

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """(special, part): special strings, and between them the text, normalised."""
        parts = self.apart.split(text) if self.apart is not None and self.hint in text else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield True, part
            elif part:
                yield False, part.lower() if part.isascii() else self._normal(unicodedata.normalize("NFC", part))

    @staticmethod
    def _normal(text: str) -> str:
        """Each letter by itself: no final sigma."""
        text = text.replace("Σ", "σ")
        return (text.translate(LATER_CAPITALS) if _LATER_CAPITAL.search(text) else text).lower()

    @functools.cached_property
    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """inner, last, and pairs as sorted keys and their values."""
        keys = np.array(sorted(self.pairs), dtype=np.int64)
        return np.array(self.inner), np.array(self.last), keys, np.array([self.pairs[k] for k in keys.tolist()], dtype=np.int64)

    def symbols(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        out = [self.inner[b] for b in data]
        out[-1] = self.last[data[-1]]
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One copy in each Python process."""
    return Vocabulary(path)


def merge(symbols: list[int], pairs: dict[int, int], size: int) -> int:
    """Byte-pair merging in place over a linked list; returns the number of merges.

    A heap holds the adjacent pairs by rank, then position; a popped pair counts if both of its symbols are still
    those it was made of. A merged-away symbol becomes -1, so what is left of symbols are the tokens.
    """
    n = len(symbols)
    get, heap = pairs.get, []
    for i in range(n - 1):
        found = get(symbols[i] * size + symbols[i + 1])
        if found is not None:
            heap.append((found // size, i, found % size, symbols[i], symbols[i + 1]))
    if not heap:
        return 0
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        _, i, new, a, b = pop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = new, -1
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (found := get(new * size + symbols[k])) is not None:
                push(heap, (found // size, i, found % size, new, symbols[k]))
        h = before[i]
        if h >= 0 and (found := get(symbols[h] * size + new)) is not None:
            push(heap, (found // size, h, found % size, symbols[h], new))
    return merges


def merged_short(symbols: list[int], pairs: dict[int, int], size: int) -> list[int]:
    """The tokens of a few symbols, as merge() makes them: always the first of the adjacent pairs of least rank. A scan of a
    short list costs less than a heap."""
    get, none = pairs.get, size * size
    found = [get(a * size + b, none) for a, b in zip(symbols, symbols[1:])]
    while found and (least := min(found)) != none:
        i, new = found.index(least), least % size
        symbols[i : i + 2] = [new]
        del found[i]
        if i:
            found[i - 1] = get(symbols[i - 1] * size + new, none)
        if i < len(found):
            found[i] = get(new * size + symbols[i + 1], none)
    return symbols


def merged_many(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, ends): the tokens of many words one after another, as merge() makes them, and where each word's end. All
    words go in step: a round merges in each the first of its adjacent pairs of least rank, and words without one are done."""
    inner, last, keys, values = v.arrays
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    letters, ends = np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([len(d) for d in data])
    symbols = inner[letters]
    symbols[ends - 1] = last[letters[ends - 1]]
    word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    none = v.size * v.size

    def pairs(at: np.ndarray) -> np.ndarray:
        after = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] * v.size + symbols[after]
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((after > at) & (word[at] == word[after]) & (keys[place] == key), values[place], none)

    found, done = pairs(np.arange(len(symbols))), []
    while len(symbols):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        least = np.repeat(np.minimum.reduceat(found, starts), np.diff(starts, append=len(symbols)))
        keep = least != none
        if not keep.all():
            done.append((word[~keep], symbols[~keep]))
        at = np.flatnonzero(keep & (found == least))
        at = at[np.diff(word[at], prepend=-1) != 0]
        symbols[at] = least[at] % v.size
        keep[at + 1] = False
        changed = np.zeros(len(symbols), dtype=bool)
        changed[at] = changed[at[at > 0] - 1] = True
        # A symbol before a word's first has no pair, and so has none when looked up again.
        symbols, word, found, changed = symbols[keep], word[keep], found[keep], np.flatnonzero(changed[keep])
        found[changed] = pairs(changed)
    word, tokens = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
    order = np.argsort(word, kind="stable")
    return tokens[order], np.cumsum(np.bincount(word, minlength=len(words)))
