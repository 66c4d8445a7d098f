"""Phrases of two and three words that stand together more often than their parts would, from a weighted de Bruijn graph.

A node is two consecutive words, an edge three, its weight their count. Only the longest are counted in the texts; what a
word or two words count follows from the flow through them: what leaves a node by its edges, and what ends there with its
piece. A node that all its flow enters by one edge and leaves by one is unary: paths through such nodes are compacted to
one row, on which every shorter phrase counts the same."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, near, staged, text_or_empty
from .words import PIECE_BYTES, cut_text, mix, word_hashes

PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
#: A word's number has so many bits at most where three numbers are one key.
BITS = 21
#: The frequent words of all languages that are sent to every task (12 bytes each, 24 MB at most); of more words, hashes are the
#: numbers, and nothing is sent.
MOST_SENT = (1 << BITS) - 2
#: Words and triples that a task counts before it hands them on.
HELD_WORDS, HELD_TRIPLES = 1 << 19, 1 << 21

_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in PIECE_ENDS]] = True
_BETWEEN = _ENDS.copy()
_BETWEEN[[0x20, 0x09]] = True
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, bool]]:
    """(language, lower-cased text, whether it goes on in the next block) of texts joined by a piece end, language by language, and of long texts
    in parts that end between words."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def block(lang: str) -> tuple[str, bytes, bool]:
        sizes[lang] = 0
        return lang, b"\n".join(held.pop(lang)), False

    for batch in batches:
        for lang, value in zip(batch.columns[0].to_pylist(), batch.columns[1]):
            text = value.as_buffer().to_pybytes().translate(_LOWER)
            if len(text) > PIECE_BYTES:
                parts = list(cut_text(text, _BETWEEN))
                yield from ((lang, part, i < len(parts) - 1) for i, part in enumerate(parts))
                continue
            if sizes.get(lang, 0) + len(text) > PIECE_BYTES:
                yield block(lang)
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text) + 1
    for lang in list(held):
        yield block(lang)


@functools.lru_cache(maxsize=1024)
def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def _words(lang: str, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 63-bit hash over language and word, never 0) of each word of a lower-cased text."""
    at, hashes = word_hashes(text, _BETWEEN)
    return at, (mix(hashes ^ _salt(lang)) >> np.uint64(1)).astype(np.int64) | 1


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, hash, n) of texts(lang, text): all words, by task counts that are then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], list[int]] = {}

        def rows() -> pa.RecordBatch:
            langs, words = [k[0] for k in held], pa.array([k[1] for k in held], type=pa.binary()).view(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(langs, type=pa.string()), words, pa.array([v[0] for v in held.values()]), pa.array([v[1] for v in held.values()])], names=["lang", "word", "hash", "n"])

        for lang, text, _ in _blocks(batches):
            at, hashes = _words(lang, text)
            values, first, n = np.unique(hashes, return_index=True, return_counts=True)
            data = np.frombuffer(text, dtype=np.uint8)
            stops = np.append(np.flatnonzero(_BETWEEN[data]), len(text))
            begins = at[first]
            ends = stops[np.searchsorted(stops, begins)]
            for h, b, e, c in zip(values.tolist(), begins.tolist(), ends.tolist(), n.tolist()):
                held.setdefault((lang, text[b:e]), [h, 0])[1] += c
            if len(held) > HELD_WORDS:
                yield rows()
                held.clear()
        if held:
            yield rows()

    counted = texts.mapInArrow(count, "lang string, word string, hash long, n long")
    return counted.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


def _stream(numbers: np.ndarray, at: np.ndarray, text: bytes, before: np.ndarray) -> np.ndarray:
    """The numbers of the words that begin at `at`, with a 0 for each piece end, behind what an earlier part left."""
    ends = np.flatnonzero(_ENDS[np.frombuffer(text, dtype=np.uint8)])
    return np.concatenate([before, np.insert(numbers, np.searchsorted(at, ends), 0)])


def _triples(stream: np.ndarray, goes_on: bool) -> np.ndarray:
    """Each word with the two that follow it in its piece, 0 where there is none; of a text that goes on, but its last two."""
    padded = np.concatenate([stream, np.zeros(0 if goes_on else 2, np.int64)])
    if len(padded) < 3:
        return np.zeros((0, 3), np.int64)
    rows = np.stack([padded[:-2], padded[1:-1], padded[2:]], axis=1)
    rows[rows[:, 1] == 0, 2] = 0
    return rows[rows[:, 0] != 0]


def count_edges(texts: DataFrame, sent: tuple[np.ndarray, np.ndarray] | None) -> tuple[DataFrame, Column, Column, Column]:
    """Counts (key columns, n) of each word with the next two of its piece, and the three words' numbers as columns of it.

    With sent (sorted hashes of the frequent words, their numbers from 1) the three numbers are one key, and other
    words end a piece, as no frequent phrase holds them. Without, a word's hash is its number, and the key has three columns.
    """
    names = ["a", "b", "c"] if sent is None else ["key"]
    shared = texts.sparkSession.sparkContext.broadcast(sent) if sent is not None else None

    def packed(rows: np.ndarray) -> np.ndarray:
        return rows if shared is None else ((rows[:, :1] << (2 * BITS)) | (rows[:, 1:2] << BITS) | rows[:, 2:])

    def folded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if keys.shape[1] == 1:
            values, n = np.unique(keys[:, 0], return_counts=True)
            return values[:, None], n
        order = np.lexsort(keys.T[::-1])
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(keys, axis=0) != 0).any(axis=1)]))
        return keys[first], np.diff(np.append(first, len(keys)))

    def numbers_of(hashes: np.ndarray) -> np.ndarray:
        if shared is None:
            return hashes
        known, numbers = shared.value
        if not len(known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, numbers[at], 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        before = np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            keys, n = folded(np.concatenate(held))
            held.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(keys[:, i])) for i in range(keys.shape[1])], pa.array(n.astype(np.int64))], names=[*names, "n"])

        for lang, text, goes_on in _blocks(batches):
            at, hashes = _words(lang, text)
            stream = _stream(numbers_of(hashes), at, text, before)
            # The last two words of a part wait for those that follow.
            before = stream[-2:] if goes_on else stream[:0]
            held.append(packed(_triples(stream, goes_on)))
            if sum(map(len, held)) > HELD_TRIPLES:
                yield rows()
        if held:
            yield rows()

    counted = texts.mapInArrow(count, ", ".join(f"{c} long" for c in [*names, "n"])).groupBy(*names).agg(F.sum("n").alias("n"))
    if sent is None:
        return counted, F.col("a"), F.col("b"), F.col("c")
    low = F.lit((1 << BITS) - 1)
    return counted, F.shiftright("key", 2 * BITS), F.shiftright("key", BITS).bitwiseAND(low), F.col("key").bitwiseAND(low)


def frequent_graph(texts: DataFrame, least: int, most_sent: int = MOST_SENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals) of texts(lang, text): phrases(a, b, c, n) of one, two (c = 0) and three words'
    numbers that count `least` at least, words(number, lang, word) and totals(lang, n)."""
    counted = staged(count_words(texts), "phrases-words")
    totals = staged(counted.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    words = counted.filter(F.col("n") >= least)
    found = words.count()
    if found <= most_sent:
        # In the order of their counts, so that frequent words have small numbers and rows of keys compress.
        rows = words.select("hash", "n").toArrow()
        known, counts = (rows.column(c).to_numpy().astype(np.int64) for c in ("hash", "n"))
        numbers = np.empty(len(known), np.int64)
        numbers[np.lexsort((known, -counts))] = np.arange(1, len(known) + 1)
        order = np.argsort(known)
        sent = known[order], numbers[order]
        listed = texts.sparkSession.createDataFrame(pa.table({"hash": known, "number": numbers}))
        words = words.join(F.broadcast(listed), "hash").select("number", "lang", "word")
    else:
        sent = None
        words = words.select(F.col("hash").alias("number"), "lang", "word")
    words = staged(words, "phrases-frequent-words")
    edges, a, b, c = count_edges(texts, sent)
    # Each edge adds its weight to the node it leaves, ends of pieces (c = 0, b = 0) too, and to that node's first word.
    none = F.lit(0).cast("long")
    row = lambda *x: F.struct(*[v.alias(k) for v, k in zip(x, ("a", "b", "c", "n"))])
    n = F.col("n")
    flows = F.array(row(a, none, none, n), F.when(b != 0, row(a, b, none, n)), F.when((c != 0) & (n >= least), row(a, b, c, n)))
    flows = edges.select(F.explode(flows).alias("x")).filter(F.col("x").isNotNull()).select("x.*")
    phrases = staged(flows.groupBy("a", "b", "c").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrases-graph")
    discard(counted)
    return phrases, words, totals


def compact_paths(phrases: DataFrame) -> DataFrame:
    """(words, n): the edges of phrases(a, b, c, n) with unary paths made one row of three word numbers or more.

    A node is unary if one edge brings all that it counts and one takes all of it. Each edge that a unary node begins
    points to the edge before it; pointers are doubled by joins until all point to the first edge of their path. No path
    is longer than a piece, as none goes on beyond a piece's end.
    """
    nodes = phrases.filter("b <> 0 and c = 0").select("a", "b", F.col("n").alias("node_n"))
    edges = phrases.filter("c <> 0")
    into = edges.join(nodes.select(F.col("a").alias("b"), F.col("b").alias("c"), "node_n"), ["b", "c"]).filter("n = node_n").select(F.struct("a", "b", "c").alias("before"), F.col("b").alias("x"), F.col("c").alias("y"))
    out = edges.join(nodes, ["a", "b"]).filter("n = node_n").select(F.struct("a", "b", "c").alias("edge"), F.col("a").alias("x"), F.col("b").alias("y"))
    linked = staged(into.join(out, ["x", "y"]).select("edge", F.col("before").alias("to"), F.lit(1).cast("long").alias("steps")), "phrases-links")
    while True:
        onward = linked.select(F.col("edge").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"))
        doubled = staged(linked.join(onward, "to", "left").select("edge", F.coalesce("further", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved")), "phrases-links")
        discard(linked)
        linked = doubled.drop("moved")
        linked.staged_path = doubled.staged_path
        if doubled.filter("moved").isEmpty():
            break
    edges = edges.withColumn("edge", F.struct("a", "b", "c")).join(linked, "edge", "left")
    placed = edges.select(F.coalesce("to", "edge").alias("first"), F.coalesce("steps", F.lit(0)).alias("place"), "c", "n")
    paths = placed.groupBy("first").agg(F.array_sort(F.collect_list(F.struct("place", "c"))).alias("tail"), F.min("n").alias("n"))
    paths = staged(paths.select(F.concat(F.array("first.a", "first.b"), F.transform("tail", lambda t: t["c"])).alias("words"), "n"), "phrases-paths")
    discard(linked)
    return paths


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in whole numbers of up to 38 digits; a is at most left and right."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (wide(a) * wide(a)).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, contained_percent: int = 50, most_sent: int = MOST_SENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language of docs(lang, text).

    A-Z are lower-cased; texts are cut to pieces at .,;:!? and line ends, pieces to words at space and tab. A phrase of two or
    three words that counts a >= least is a candidate; of the cuts into a first part (count l) and the rest (r) the
    one of the least score floor(1000000 a a / (l r)) counts, then the shorter first part. A phrase within a longer
    candidate that counts contained_percent of it or more is dropped. n counts all words of the language. A null
    language is `und`, a null text is empty; repeated rows count each; languages without a candidate and an empty table
    give no rows; other columns are not read. A text may be of any length: it is counted in parts. Counts up to
    10**15 are exact. Words are told apart by 63 bits of a hash over language and word: the odds that any two of a
    million frequent words of all share one are 1e-7.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    phrases, words, totals = frequent_graph(texts, least, most_sent)
    paths = compact_paths(phrases)
    nodes = staged(phrases.filter("b <> 0 and c = 0").select("a", "b", "n"), "phrases-nodes")
    single = phrases.filter("b = 0").select(F.col("a").alias("number"), "n")
    last = F.size("words") - 3
    edge = lambda i: F.struct(*[F.get("words", i + k).alias(c) for k, c in enumerate("abc")], (i > 0).alias("begins"), (i < last).alias("ends"))
    threes = paths.select("n", F.explode(F.transform(F.sequence(F.lit(0), last), edge)).alias("e")).select("e.*", "n")
    # Only the ends of a path have counts of their own; within it every pair counts as the path does.
    ab, bc = nodes.select("a", "b", F.col("n").alias("ab_n")), nodes.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("bc_n"))
    head = threes.filter("not begins").join(ab, ["a", "b"]).unionByName(threes.filter("begins").withColumn("ab_n", F.col("n")))
    both = head.filter("not ends").join(bc, ["b", "c"]).unionByName(head.filter("ends").withColumn("bc_n", F.col("n")))
    singles = single.count()
    count_of = lambda word, name: near(single.select(F.col("number").alias(word), F.col("n").alias(name)), singles)
    threes = staged(both.join(count_of("a", "a_n"), "a").join(count_of("c", "c_n"), "c"), "phrases-threes")
    first, second = _score(F.col("n"), F.col("a_n"), F.col("bc_n")), _score(F.col("n"), F.col("ab_n"), F.col("c_n"))
    later = second < first
    scored = threes.select("a", "b", "c", F.col("n").alias("count"), F.when(later, F.col("ab_n")).otherwise(F.col("a_n")).alias("l"), F.when(later, F.col("c_n")).otherwise(F.col("bc_n")).alias("r"), F.least(first, second).alias("score"))
    # A pair inside a path counts as the longer phrases over it, so only pairs at the ends of paths can stay.
    covered = threes.select(F.explode(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), "n"))).alias("x")).select("x.*")
    covered = covered.groupBy("a", "b").agg(F.max("n").alias("longer"))
    twos = nodes.join(covered, ["a", "b"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < contained_percent * F.col("n")))
    twos = twos.join(count_of("a", "l"), "a").join(count_of("b", "r"), "b")
    twos = twos.select("a", "b", F.lit(0).cast("long").alias("c"), F.col("n").alias("count"), "l", "r", _score(F.col("n"), F.col("l"), F.col("r")).alias("score"))
    every = scored.unionByName(twos)
    for name in "abc":
        spelt = words.select(F.col("number").alias(name), *([F.col("lang")] if name == "a" else []), F.col("word").alias(f"{name}_word"))
        every = every.join(spelt, name, "left" if name == "c" else "inner")
    every = every.select("lang", F.concat_ws(" ", "a_word", "b_word", "c_word").alias("phrase"), "count", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("count"), "phrase")
    ranked = every.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", F.col("count").alias("a"), "l", "r", "n", "score")
