"""Token counts by byte-pair merging, without making the tokens."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .bpe import Vocabulary, merge, merged_short, vocabulary
from .shared import text_or_empty

#: Strings whose values a Python process keeps, strings whose counts it keeps (a number each), and the longest such.
KEPT_WORDS = 100_000
KEPT_COUNTS = 500_000
KEPT_LENGTH = 40
#: Symbols up to which a word is merged by scans.
SHORT = 48


def count_word(word: str, v: Vocabulary) -> int:
    """Initial symbols minus merges."""
    symbols = v.symbols(word)
    if len(symbols) <= SHORT:
        return len(merged_short(symbols, v.pairs, v.size))
    return len(symbols) - merge(symbols, v.pairs, v.size)


class Kept(dict):
    """Values by string, made when first asked for; at most `most`. In the newer half is what was asked for since it was
    begun; once it is full it becomes the older half, of which only what is asked for again is kept on. So frequent strings
    stay, whatever number of rare ones passes."""

    def __init__(self, make, most: int = KEPT_WORDS):
        super().__init__()
        self.make, self.half, self.older = make, max(1, most // 2), {}

    def __missing__(self, word: str):
        value = self.older.pop(word, None)
        if value is None:
            value = self.make(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


class Counter:
    """Token counts of texts. No word reaches over a space, so what stands between spaces is counted by itself."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.chunks = Kept(self._chunk, KEPT_COUNTS)

    def _chunk(self, chunk: str) -> int:
        """Of a word, which is a chunk of its own, or of words that stand without a space between them."""
        n = 0
        for word in self.v.split(chunk):
            n += count_word(word, self.v) if word == chunk else self.chunks[word]
        return n

    def count(self, text: str) -> int:
        get = self.chunks.__getitem__
        return sum(1 if special else sum(map(get, part.replace("\n", " ").split(" "))) for piece in self.v.pieces(text) for special, part in self.v.segments(piece))


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One in each Python process."""
    return Counter(vocabulary(path))


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text (null: of the empty text, none) for the vocabulary file at path."""

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        for texts in batches:
            yield pd.Series(list(map(own.count, texts)), dtype="int64")

    return count(text_or_empty(text))


def count_documents(docs: DataFrame, path: str, limit: int = 2048, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns + (n_bytes, n_tokens, over_limit) for each row of docs(text, ...), repeated rows included.

    path is a vocabulary file of the tokenizers library with word ends; special strings inside a text count as one
    token each. Null texts count as empty: no bytes, no tokens. A text is held once, its words one by one; the kept
    counts are bounded. An empty table gives no rows.
    """
    text = text_or_empty()
    counted = docs.select(*keep, F.octet_length(text).cast("long").alias("n_bytes"), token_count(F.col("text"), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
