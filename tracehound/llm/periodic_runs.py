"""Periodic runs of words: stretches that repeat a block of words four times or more, found by minimizers of several scales.

A scale P looks for periods above P/2 and up to P. Its minimizers are the least hashes of P consecutive words among P/2
neighbouring places. Inside a run the minimizers repeat at the distance of its period, and as P words are one period at
least, equal ones stand at multiples of it: two consecutive equal minimizers at such a distance are a seed, which is
extended word by word to the run's ends. Periods up to 8 are found by comparing every word with the one that lag behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty
from .words import mix

#: A run has that many words and that many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Periods up to this one are found by direct lag scans.
SHORT_PERIOD = 8
#: Words of several texts that are looked at together; a longer text is looked at alone.
BATCH_WORDS = 1 << 17

_PAIR = np.uint64(0xA24BAED4963EE407)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _stretches(true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the stretches of true values, and the places behind their last."""
    edges = np.flatnonzero(np.diff(true.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of each `width` (a power of two) neighbours, by their first place."""
    step = 1
    while step < width:
        values = best(values[:-step], values[step:])
        step *= 2
    return values


def _extend(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch of places around `at` whose words equal those `lag` behind: first place, and one behind the last."""
    high, step = at, 64
    while True:
        behind = ids[high + lag : high + lag + step]
        differ = np.flatnonzero(ids[high : high + len(behind)] != behind)
        if len(differ):
            high += int(differ[0])
            break
        high += len(behind)
        if len(behind) < step:
            break
        step *= 2
    low, step = at, 64
    while low > 0:
        first = max(0, low - step)
        differ = np.flatnonzero(ids[first:low] != ids[first + lag : low + lag])
        if len(differ):
            low = first + int(differ[-1]) + 1
            break
        low = first
        step *= 2
    return low, high


def _seeds(grams: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of the consecutive equal minimizers of a scale at a lag above scale / 2 and up to scale."""
    window = scale // 2
    if len(grams) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _sliding(grams, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    # A place is a minimizer if the least value of some window over it is its own; ties are all minimizers.
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), window, np.maximum) == grams)
    chosen = chosen[np.argsort(grams[chosen], kind="stable")]
    lag = np.diff(chosen)
    seed = (np.diff(grams[chosen]) == 0) & (lag > window) & (lag <= scale)
    return chosen[:-1][seed], lag[seed]


def runs_of(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs in a row of texts: ids are word numbers from 0, each text closed by a
    negative number of its own; lengths, which fall, count the words of the texts."""
    found: list[np.ndarray] = []
    for lag in range(1, SHORT_PERIOD + 1):
        low, high = _stretches(ids[:-lag] == ids[lag:])
        long = high - low + lag >= max(LEAST_WORDS, LEAST_PERIODS * lag)
        found.append(np.stack([low[long], high[long] - low[long] + lag, np.full(int(long.sum()), lag)], axis=1))
    ends = np.concatenate([[0], np.cumsum(lengths + 1)])
    grams, width = mix(ids.astype(np.uint64)), 1
    while True:
        # Texts that are too short for the next scale stand at the end.
        scale = 2 * width
        texts = int(np.searchsorted(-lengths, -LEAST_PERIODS * (scale // 2 + 1), side="right"))
        if scale > SHORT_PERIOD and not texts:
            break
        if scale > SHORT_PERIOD:
            grams = grams[: ends[texts]]
        grams = mix(grams[:-width] * _PAIR + grams[width:]) if len(grams) > width else grams[:0]
        width = scale
        if scale > SHORT_PERIOD:
            at, lags = _seeds(grams, scale)
            for lag in np.unique(lags):
                places = np.sort(at[lags == lag])
                i = 0
                while i < len(places):
                    low, high = _extend(ids, int(places[i]), int(lag))
                    if high - low + lag >= LEAST_PERIODS * lag:
                        found.append(np.array([[low, high - low + lag, lag]]))
                    # Seeds within this stretch lead to it again; a false seed leads nowhere.
                    i = max(i + 1, int(np.searchsorted(places, high)))
    runs = np.concatenate(found)
    # A stretch that repeats a multiple of its smallest period is found with both.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.concatenate([[True], (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)])] if len(runs) else runs


def texts_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of each text, a list of words, by start, then period."""
    numbers: dict[bytes, int] = {}
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
    parts = [np.array([numbers.setdefault(w, len(numbers)) for w in texts[i]] + [-1 - k], dtype=np.int64) for k, i in enumerate(order)]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    ends = np.cumsum(lengths + 1)
    runs = runs_of(ids, lengths)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    bounds = np.searchsorted(runs[:, 0], ends)
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    for k, (i, low, high) in enumerate(zip(order, [0, *bounds[:-1]], bounds)):
        if high > low:
            out[i] = runs[low:high] - np.array([ends[k] - lengths[k] - 1, 0, 0])
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run repeats, with one space between them."""
    if not len(runs):
        return b" ".join(words)
    # A word goes if any run has begun and not ended there: +1 behind each run's first period, -1 behind its end.
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def periodic_runs(docs: DataFrame, text: str | Column = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns + (runs, collapsed) for each row of docs, repeated rows included.

    runs: start (word number), length and period in words of every run, by start, then period. A run is a stretch of
    LEAST_WORDS words and LEAST_PERIODS times its smallest period at least that no neighbouring word extends. collapsed:
    the words that no run contains after its first period, with one space between them. Words are what space and the
    ASCII controls 9 to 13 part, compared byte by byte. Null and empty texts have no runs and an empty collapsed text;
    a text is whole in one task, its size times some hundred bytes a word; nothing is shuffled. Clashing column names and
    an empty table are no matter. A seed is lost only if two different word sequences share a 64-bit hash (odds below
    1e-9 for a text of 100,000 words); what is found is compared word by word.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*keep).schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), f"runs {RUNS}", "collapsed string"])
    rows = docs.select(*keep, text_or_empty(text).alias("__text"))

    def described(rows: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = texts_runs(texts)
        all_runs = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
        structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(all_runs[:, c])) for c in range(3)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)), structs)
        left = pa.array([collapsed(w, r) for w, r in zip(texts, runs)], type=pa.binary()).view(pa.string())
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], lists, left], names=[*keep, "runs", "collapsed"])

    def described_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, texts, words = 0, [], 0
            for i, value in enumerate(batch.columns[-1]):
                own = value.as_buffer().to_pybytes().split()
                if texts and words + len(own) > BATCH_WORDS:
                    yield described(batch.slice(begin, i - begin), texts)
                    begin, texts, words = i, [], 0
                texts.append(own)
                words += len(own)
            if texts:
                yield described(batch.slice(begin), texts)

    return rows.mapInArrow(described_all, schema)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period (compared as exact fractions), of these the one of smallest start, then
    period; null if there is none."""
    none = F.lit(None).cast(RUNS.removeprefix("array<").removesuffix(">"))
    better = lambda a, b: a["length"] * b["period"] < b["length"] * a["period"]
    return F.aggregate(runs, none, lambda a, b: F.when(a.isNull() | better(a, b), b).otherwise(a))


def fold(docs: DataFrame) -> DataFrame:
    """docs with a text in ten made periodic from some word on: that of the rows whose crc32(doc_id as text), h, is
    divisible by 10. With g = floor(h / 10) and n words, word i >= a = g % n becomes word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)). Rows without doc_id or words stay as they are."""
    spare = ("__words", "__n", "__h", "__g", "__a", "__p")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(text_or_empty(), r"[\x20\x09-\x0D]+"), "")
    folded = F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False))
    rows = docs.withColumn("__words", F.when(folded, words).otherwise(F.array().cast("array<string>"))).withColumns({"__n": F.size("__words").cast("long"), "__h": h})
    # The word count and what follows from it are columns, so that no lambda makes them anew for each word.
    rows = rows.withColumn("__g", F.floor(F.col("__h") / 10)).withColumn("__a", F.when(F.col("__n") > 0, F.pmod("__g", "__n")))
    rows = rows.withColumn("__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.pmod(F.col("__g"), F.lit(8)))))
    source = lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + F.pmod(i - F.col("__a"), F.col("__p")))
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1), lambda i: F.get("__words", source(i).cast("int"))), " ")
    return rows.withColumn("text", F.when(F.col("__n") > 0, again).otherwise(F.col("text"))).drop(*spare)
