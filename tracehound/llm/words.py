"""Hashes of the words of many texts at once, in numpy.

Words are runs of bytes other than space and the ASCII controls 9 to 13; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text in one piece of work.
PIECE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(piece: bytes, separator: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(first byte, 64-bit hash, hash of the first p bytes for p in prefixes) of each word of a piece."""
    data = np.frombuffer(piece, dtype=np.uint8)
    inside = ~separator[data]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, dtype=np.int64), *[np.zeros(0, dtype=np.uint64) for _ in range(1 + len(prefixes))]
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    lengths = np.diff(np.concatenate([first, [len(at)]]))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()) - 1, _BASE)]), dtype=np.uint64)
    places = np.arange(len(at)) - np.repeat(first, lengths)
    terms = _LETTERS[data[at]] * powers[places]
    out = [at[first], mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _BASE)]
    for p in prefixes:
        out.append(mix(np.add.reduceat(terms * (places < p), first) + np.uint64(p)))
    return tuple(out)


def cut_text(text: bytes, separator: np.ndarray) -> Iterator[bytes]:
    """A long text in pieces that end between words."""
    start = 0
    while len(text) - start > PIECE_BYTES:
        end = start + PIECE_BYTES
        while end < len(text) and not separator[text[end]]:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def documents_hashes(texts: Iterable[str | None], separator: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """For runs of consecutive texts, the hashes of each text's words; null is the empty text."""
    run: list[bytes] = []
    size = 0

    def of_run() -> list[tuple[np.ndarray, ...]]:
        starts, *hashes = word_hashes(b" ".join(run), separator, prefixes)
        bounds = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in run])[:-1])
        return list(zip(*(np.split(h, bounds) for h in hashes)))

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if run and size + len(data) > PIECE_BYTES:
            yield of_run()
            run, size = [], 0
        if len(data) > PIECE_BYTES:
            pieces = [word_hashes(piece, separator, prefixes)[1:] for piece in cut_text(data, separator)]
            yield [tuple(map(np.concatenate, zip(*pieces)))]
        else:
            run.append(data)
            size += len(data) + 1
    if run:
        yield of_run()


def documents_words(texts: Iterable[str | None]) -> Iterator[list[np.ndarray]]:
    """For runs of consecutive texts, the word hashes of each."""
    for run in documents_hashes(texts):
        yield [words for (words,) in run]


def separators(also: str) -> np.ndarray:
    """White space and the ASCII characters of `also`."""
    out = _SPACE.copy()
    out[[ord(c) for c in also]] = True
    return out
