"""Byte-pair encoding and decoding as streaming transducers with constant memory.

Encoding reads a word's symbols into a window. What later symbols can still change reaches back a bounded number of
symbols, which follows from the merge list: a merge (a, b) fails to come about only if its right part is taken by an
earlier merge with what follows, which in turn depends on still earlier merges further right. Tokens that end that far
before the window's end are stable and are emitted; the window goes on from there.
"""

from __future__ import annotations

import bisect
import codecs
import functools
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import batched, chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, merge, merged_many, merged_short, vocabulary
from .shared import text_or_empty
from .token_counts import KEPT_LENGTH, KEPT_WORDS, SHORT, Kept

#: Characters of a text, or of several, whose chunks are looked up together.
LOT = 1 << 18


@functools.lru_cache(maxsize=4)
def sufficient_lookahead(path: str) -> int:
    """Symbols right of a token's end that settle it.

    By rising rank: whether merge r = (a, b) comes about at a place depends on b's symbols and on the earlier merges
    that can take b, or the last part of b while b is being made, as their left side. reach[r] = length of b + the
    largest reach of those. Symbols on the left side matter too, but they are known.
    """
    v = vocabulary(path)
    length: dict[int, int] = {}
    ranks: dict[int, list[int]] = {}  # left side -> ranks of merges, rising, and the running maximum of their reach
    reaches: dict[int, list[int]] = {}
    most = 1

    def taken(token: int, before: int) -> int:
        at = bisect.bisect_left(ranks.get(token, ()), before)
        return reaches[token][at - 1] if at else 0

    for rank, (a, b, _) in enumerate(v.merges):
        reach, token, limit = 0, b, rank
        while True:
            reach = max(reach, taken(token, limit))
            if token not in v.parts or v.parts[token][2] >= rank:
                break
            _, token, limit = v.parts[token]
        n = length.setdefault(b, _symbols(b, v))
        reach += n
        most = max(most, reach)
        ranks.setdefault(a, []).append(rank)
        reaches.setdefault(a, []).append(max(reach, reaches[a][-1] if reaches.get(a) else 0))
    return most


def _symbols(token: int, v: Vocabulary) -> int:
    return len(v.strings[token].removesuffix(v.suffix)) or 1


def encode_symbols(symbols: Iterable[int], v: Vocabulary, lookahead: int) -> Iterator[int]:
    """The tokens of one word, from its symbols as they come; at most some lookaheads of symbols are held."""
    window: list[int] = []
    full = 4 * lookahead + 64
    for s in symbols:
        window.append(s)
        if len(window) >= full:
            merged = window.copy()
            merge(merged, v.pairs, v.size)
            stable, start = len(window) - lookahead, 0
            starts = [i for i, t in enumerate(merged) if t >= 0]
            for i, end in zip(starts, [*starts[1:], len(window)]):
                if end > stable:
                    break
                yield merged[i]
                start = end
            window = window[start:]
    merge(window, v.pairs, v.size)
    yield from (t for t in window if t >= 0)


def _stream(word: str, v: Vocabulary) -> Iterator[int]:
    data = word.encode("utf-8", "surrogatepass")
    for b in data[:-1]:
        yield v.inner[b]
    yield v.last[data[-1]]


class Encoder:
    """Little-endian 32-bit ids of texts, chunk by chunk, from bounded pieces of the text. No word reaches over a space,
    so what stands between spaces is encoded by itself; the ids of frequent short chunks are kept."""

    def __init__(self, path: str):
        self.v, self.lookahead = vocabulary(path), sufficient_lookahead(path)
        self.chunks = Kept(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        """A word, which is a chunk of its own, or words that stand without a space between them."""
        words = list(self.v.split(chunk))
        return self._word(chunk) if words == [chunk] else b"".join(map(self.chunks.__getitem__, words))

    def _word(self, word: str) -> bytes:
        """The ids of a word short enough to be kept, whose symbols are one window."""
        symbols = self.v.symbols(word)
        if len(symbols) <= SHORT:
            return array("I", merged_short(symbols, self.v.pairs, self.v.size)).tobytes()
        merge(symbols, self.v.pairs, self.v.size)
        return array("I", [t for t in symbols if t >= 0]).tobytes()

    def _long(self, chunk: str) -> Iterator[bytes]:
        """Of a chunk too long to be kept the ids go out as they become stable."""
        for word in self.v.split(chunk):
            if len(word) <= KEPT_LENGTH:
                yield self.chunks[word]
            else:
                for some in batched(encode_symbols(_stream(word, self.v), self.v, self.lookahead), 4096):
                    yield array("I", some).tobytes()

    def encode(self, text: str) -> Iterator[bytes]:
        kept = self.chunks
        for piece in self.v.pieces(text):
            for special, part in self.v.segments(piece):
                if special:
                    yield array("I", [self.v.special[part]]).tobytes()
                else:
                    for chunk in part.replace("\n", " ").split(" "):
                        if len(chunk) <= KEPT_LENGTH:
                            yield kept[chunk]
                        else:
                            yield from self._long(chunk)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One in each Python process."""
    return Encoder(path)


class TextDecoder:
    """Ids to text, a few at a time: the letters of a token give bytes, complete characters are emitted at once, and
    a word's end gives a space. Its state is an unfinished character and whether a space is due."""

    def __init__(self, v: Vocabulary):
        self.v, self.utf8, self.due = v, codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, token: int) -> str:
        string = self.v.strings[token]
        out = " " if self.due else ""
        if string in self.v.special:
            self.due = True
            return out + string
        self.due = string.endswith(self.v.suffix)
        return out + self.utf8.decode(bytes(self.v.bytes_of[c] for c in string.removesuffix(self.v.suffix)), final=self.due)

    def end(self) -> str:
        return self.utf8.decode(b"", final=True)


class LibraryDecoder:
    """Ids to what the library's decode gives, in UTF-8, a few at a time. A file without a decoder entry has its token
    strings parted by spaces: the state is whether a space is due."""

    def __init__(self, v: Vocabulary):
        if v.decoder is not None:
            raise ValueError("only vocabulary files without a decoder entry are known")
        self.due = False

    def feed(self, strings: bytes) -> bytes:
        """The strings of some ids, parted by spaces."""
        if not strings:
            return strings
        due, self.due = self.due, True
        return b" " + strings if due else strings


class Digester:
    """Digests of the ids of texts and of what they decode to. Texts are read in lots of pieces; the chunks of a lot that are
    not kept are merged in step, and of each chunk its ids and their strings are kept. Beyond KEPT_WORDS only those of the
    last lot are kept on."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        self.v = self.encoder.v
        # Two tables of bytes, which the garbage collector has not to look through as it would a table of pairs.
        self.ids: dict[str, bytes] = {}
        self.strings: dict[str, bytes] = {}
        self.lengths = np.array([len(x.encode("utf-8")) for x in self.v.strings])

    def _learn(self, chunks: set[str]) -> None:
        words, apart, ids, strings = set(), {}, self.ids, self.strings
        for chunk in chunks.difference(ids):
            # Letters of old alphabets are the same in all databases.
            known = chunk.isascii() or max(chunk) < "\u0500"
            if known and chunk.isalpha():
                words.add(chunk)
                continue
            if known and chunk[:-1].isalpha() and chunk[-1] in ".,":
                own = [chunk[:-1], chunk[-1]]
            else:
                own = (self.v.ascii_words if chunk.isascii() else self.v.words).findall(chunk)
            words.update(own)
            if len(own) != 1 or own[0] != chunk:
                apart[chunk] = own
        new = list(words.difference(ids))
        tokens, ends = merged_many(new, self.v)
        data, begin = tokens.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        ids.update(zip(new, (data[i:j] for i, j in zip(begin, begin[1:]))))
        # Of the strings of all tokens, parted by spaces, a word's are one stretch.
        data = " ".join(map(self.v.strings.__getitem__, tokens.tolist())).encode("utf-8")
        begin = [0, *np.cumsum(self.lengths[tokens] + 1)[ends - 1].tolist()]
        strings.update(zip(new, (data[i : j - 1] for i, j in zip(begin, begin[1:]))))
        for chunk, own in apart.items():
            ids[chunk], strings[chunk] = self._joined(own)

    def _joined(self, chunks: Iterable[str]) -> tuple[bytes, bytes]:
        return b"".join(map(self.ids.__getitem__, chunks)), b" ".join(filter(None, map(self.strings.__getitem__, chunks)))

    def _runs(self, special: bool, part: str | list[str], long: set[str]) -> Iterator[tuple[bytes, bytes]]:
        if special:
            yield array("I", [self.v.special[part]]).tobytes(), part.encode("utf-8")
        elif not long or long.isdisjoint(part):
            yield self._joined(part)
        else:
            for apart, some in groupby(part, long.__contains__):
                if not apart:
                    yield self._joined(list(some))
                    continue
                for ids in chain.from_iterable(map(self.encoder._long, some)):
                    yield ids, " ".join(map(self.v.strings.__getitem__, array("I", ids))).encode("utf-8")

    def _lots(self, texts: Iterable[str]) -> Iterator[list[tuple[bool, str | list[str]] | None]]:
        """Special strings and the chunks between them; None at a text's end."""
        lot, size = [], 0
        for text in texts:
            for piece in self.v.pieces(text):
                lot += [(special, part if special else part.replace("\n", " ").split(" ")) for special, part in self.v.segments(piece)]
                size += len(piece)
                if size >= LOT:
                    yield lot
                    lot, size = [], 0
            lot.append(None)
        yield lot

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """(n_tokens, ids_sha256, decoded_sha256) of each text."""
        begun = lambda: (0, hashlib.sha256(), hashlib.sha256(), LibraryDecoder(self.v))
        n, ids_sha, text_sha, decoder = begun()
        for lot in self._lots(texts):
            chunks = set().union(*(x[1] for x in lot if x is not None and not x[0]))
            long = {c for c in chunks if len(c) > KEPT_LENGTH}
            chunks -= long
            self._learn(chunks)
            for x in lot:
                if x is None:
                    yield n, ids_sha.hexdigest(), text_sha.hexdigest()
                    n, ids_sha, text_sha, decoder = begun()
                    continue
                for ids, strings in self._runs(*x, long):
                    n += len(ids) // 4
                    ids_sha.update(ids)
                    text_sha.update(decoder.feed(strings))
            if len(self.ids) > KEPT_WORDS:
                self.ids, self.strings = ({c: kept[c] for c in chunks} for kept in (self.ids, self.strings))


@functools.lru_cache(maxsize=4)
def digester(path: str) -> Digester:
    """One in each Python process."""
    return Digester(path)


def decode(ids: Iterable[int], v: Vocabulary) -> str:
    d = TextDecoder(v)
    return "".join(map(d.feed, ids)) + d.end()


def encode_documents(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with `out`, the ids of each text as array<int>; see encode_digests for the edge cases."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for texts in batches:
            yield pd.Series([array("i", b"".join(own.encode(t))).tolist() for t in texts])

    return docs.withColumn(out, ids(text_or_empty(text)))


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with `out`, the text that array<int> `ids` stand for: words parted by one space. Null ids: empty text."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for rows in batches:
            yield pd.Series([decode(x if x is not None else (), v) for x in rows])

    return docs.withColumn(out, text(F.col(ids)))


def encode_digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns + (n_tokens, ids_sha256, decoded_sha256) for each row of docs(text, ...), repeated rows included.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers; decoded_sha256 over what LibraryDecoder gives
    for them. The ids go to both digests and the decoder as they come, and none are gathered; of a text no more than the
    row itself and one lot of pieces is held. Null texts count as empty: no tokens, digests of nothing.
    Special strings inside a text become their id. An empty table gives no rows.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = digester(path)
        for texts in batches:
            yield pd.DataFrame(own.digests(texts), columns=["n_tokens", "ids_sha256", "decoded_sha256"]).astype({"n_tokens": "int64"})

    return docs.select(*keep, digest(text_or_empty()).alias("d")).select(*keep, "d.*")
