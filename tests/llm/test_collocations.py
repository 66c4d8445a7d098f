"""Collocations against plain Python counts of all phrases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracehound.llm import collocations as C
from tracehound.llm.queries import op12_collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def wanted(docs, least=10, top=2000):
    counts = defaultdict(Counter)
    for lang, text in docs:
        for words in pieces(text):
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    rows = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in candidates.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        n, found = sum(a for p, a in f.items() if len(p) == 1), []
        for p, a in candidates.items():
            if len(p) == 2 and longer[p] and 100 * longer[p] >= 50 * a:
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        rows += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(rows)


def made(rng, n):
    texts = []
    for _ in range(n):
        words = rng.choice(["The", "the", "of", "to", "x", "Y", "é", "a b", "z"], rng.integers(0, 60), p=[0.05, 0.25, 0.2, 0.15, 0.1, 0.05, 0.1, 0.05, 0.05])
        text = "".join(w + str(rng.choice([" ", "\t", ", ", ". ", "\n", "  "], p=[0.7, 0.05, 0.08, 0.07, 0.05, 0.05])) for w in words)
        texts.append(text + (" one long passage that stands in many texts as it is: word for word " if rng.random() < 0.3 else ""))
    return texts


@pytest.mark.parametrize("most_sent", [C.MOST_SENT, 3])
def test_against_plain_counts(spark, most_sent):
    rng = np.random.default_rng(8)
    docs = [(str(rng.choice(["en", "de"])), t) for t in made(rng, 150)] + [(None, t) for t in made(rng, 40)]
    docs += [("en", None), ("en", ""), ("en", " ,. \t"), ("fr", "un deux trois " * 4), ("en", "w" * 100_000), *[("es", "uno dos")] * 12, *[("hot", "same text, same text again and again")] * 300]
    docs += [("long", "p q r s t " * 120_000), ("long", "p q, " * 300_000 + "r")]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5).withColumns({"a": F.lit("clash"), "n": F.lit(1), "score": F.lit(2)})
    got = C.collocations(df, most_sent=most_sent)
    assert got.columns == COLUMNS and sorted(map(tuple, got.collect())) == wanted(docs)


def test_query_and_its_limit(spark, tmp_path):
    rng = np.random.default_rng(9)
    docs = [("en", " ".join(f"w{i}" for i in rng.integers(0, 60, 400))) for _ in range(150)]
    spark.createDataFrame(docs, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op12_collocations(spark, str(tmp_path)).collect()))
    assert len(got) == 2000 and got == wanted(docs)


def test_paths_are_compact(spark):
    docs = [("en", "a b c d e f g h")] * 10 + [("en", "x b c y. b c d")] * 10
    texts = spark.createDataFrame(docs, "lang string, text string")
    phrases, words, _ = C.frequent_graph(texts, 10)
    name = {r["number"]: r["word"] for r in words.collect()}
    paths = {tuple(name[w] for w in r["words"]): r["n"] for r in C.compact_paths(phrases).collect()}
    # b c has two ways on and c d an end, so paths stop there; what follows is one row.
    assert paths == {("a", "b", "c"): 10, ("x", "b", "c"): 10, ("b", "c", "y"): 10, ("b", "c", "d"): 20, ("c", "d", "e", "f", "g", "h"): 10}


def test_parts_of_a_text_join_up():
    rng = np.random.default_rng(10)
    words = rng.integers(1, 5, 200)
    text = "".join(f"{w}{rng.choice([' ', ' . ', ',', '  '])}" for w in words).encode()
    whole = C._triples(C._stream(*reversed(C._words("en", text)), text, np.zeros(0, np.int64)), False)
    for _ in range(20):
        cuts = [0, *sorted(m.end() for m in re.finditer(rb"[ ,.]+", text) if rng.random() < 0.3), len(text)]
        before, rows = np.zeros(0, np.int64), []
        for low, high in zip(cuts, cuts[1:]):
            at, numbers = C._words("en", text[low:high])
            stream = C._stream(numbers, at, text[low:high], before)
            rows.append(C._triples(stream, high < len(text)))
            before = stream[-2:] if high < len(text) else stream[:0]
        assert np.array_equal(np.concatenate(rows), whole)


def test_blocks_keep_every_text():
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en", "de"], "text": ["A b", "c", "", "d " * 800_000]})
    blocks = list(C._blocks(iter([batch])))
    assert {lang: b"".join(t for k, t, _ in blocks if k == lang).split() for lang in ("en", "de")} == {"en": [b"a", b"b"], "de": [b"d"] * 800_000 + [b"c"]}
    assert [on for _, _, on in blocks] == [True, False, False, False]


def test_an_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
