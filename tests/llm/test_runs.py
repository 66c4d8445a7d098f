"""Periodic runs against a plain search over all periods and starts."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracehound.llm import periodic_runs as P
from tracehound.llm.queries import op13_periodic_runs


def brute(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(words[i : i + length - p] == words[i + p : i + length] for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng):
    words = []
    for _ in range(rng.integers(0, 6)):
        period, kinds = int(rng.integers(1, rng.choice([3, 20, 60, 90]))), int(rng.choice([2, 3, 50]))
        block = [b"%d" % x for x in rng.integers(0, kinds, period)]
        words += [block[i % period] for i in range(int(period * (0.5 + 8 * rng.random())))]
    return words


def test_runs_of_many_periods():
    rng = np.random.default_rng(0)
    for _ in range(60):
        texts = [made(rng) for _ in range(rng.integers(1, 8))]
        assert [[tuple(map(int, r)) for r in runs] for runs in P.texts_runs(texts)] == [brute(t) for t in texts]


@pytest.mark.parametrize("period", [1, 7, 8, 9, 16, 17, 33, 64, 65, 128, 200, 257])
def test_every_scale_sees_a_run_of_just_four_periods(period):
    block, around = [b"b%d" % x for x in range(period)], [b"x%d" % x for x in range(300)]
    least = max(6, 4 * period)
    whole = [block[i % period] for i in range(least)]
    runs = P.texts_runs([around[:150] + whole + around[150:], around[:5] + whole[:-1] + around[5:], whole])
    assert [[tuple(map(int, r)) for r in x] for x in runs] == [[(150, least, period)], [], [(0, least, period)]]


def test_a_long_text_of_one_word_and_one_of_two():
    (one, two) = P.texts_runs([[b"a"] * 300_000, [b"a", b"b"] * 100_000])
    assert one.tolist() == [[0, 300_000, 1]] and two.tolist() == [[0, 200_000, 2]]


def folded(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def wanted(doc_id, text):
    words = folded(doc_id, (text or "").encode().split())
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    docs = [(i, b" ".join(made(rng)).decode()) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \t\n"), (203, "ä\u00a0b " * 40), (204, "A a A a A a A a"), (None, "x " * 50), (7, docs[7][1]), (7, docs[7][1]), (205, "w" * 300_000)]
    docs += [(i, "one two three four five six seven eight nine ten " * 3) for i in range(300, 360)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"runs": F.lit(1), "collapsed": F.lit("x"), "__text": F.lit("y")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == COLUMNS
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((wanted(*d) for d in docs), key=key)


def test_many_texts_of_which_some_fill_a_batch_alone(spark, monkeypatch):
    monkeypatch.setattr(P, "BATCH_WORDS", 100)
    rng = np.random.default_rng(5)
    texts = [made(rng) for _ in range(40)]
    df = spark.createDataFrame([(i, b" ".join(t).decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in P.periodic_runs(df).collect()}
    assert [[(r["start"], r["length"], r["period"]) for r in rows[i]["runs"]] for i in range(40)] == [brute(t) for t in texts]


def test_an_empty_table(spark):
    assert P.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
