"""Tokens, near duplicates, neighbours, toxicity and the pipeline on small tables."""

import hashlib
import os
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tracehound.llm import transducer  # noqa: E402
from tracehound.llm.bpe import merge, vocabulary  # noqa: E402
from tracehound.llm.minhash import near_duplicates  # noqa: E402
from tracehound.llm.neighbours import search  # noqa: E402
from tracehound.llm.token_counts import count_documents  # noqa: E402
from tracehound.llm.toxicity import Classifier, feature_rows, score_documents  # noqa: E402
from tracehound.llm.transducer import decode_documents, encode_digests, encode_documents  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"
TEXTS = ["", None, " ", "Hello, WORLD! don't  stop", "<|endoftext|>a<|startoftext|> b<|endo", "ΑΣ ΣΑΣ İstanbul ß", "a\x1cb\u0085c　d", "x" * 5000, "aaab" * 3000, "é 12³ ½", "日本語 한국 \U0001f600", "hello hello"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_tokens_equal_the_library(spark, library):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    counts = {r["doc_id"]: r for r in count_documents(df, PATH).collect()}
    digests = {r["doc_id"]: r for r in encode_digests(df, PATH).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert counts[i]["n_tokens"] == digests[i]["n_tokens"] == len(ids)
        assert counts[i]["n_bytes"] == len((t or "").encode()) and counts[i]["over_limit"] == (len(ids) > 2048)
        assert digests[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert count_documents(df.limit(0), PATH).count() == 0 and encode_digests(df.limit(0), PATH).count() == 0


def test_round_trip(spark):
    texts = ["the cat sat", "don ' t", "naïve café \U0001f600"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = decode_documents(encode_documents(df, PATH), PATH)
    assert {r["doc_id"]: r["decoded"].strip() for r in out.collect()} == dict(enumerate(texts))


def test_streaming_equals_merging_at_once():
    v, far, rng = vocabulary(PATH), transducer.sufficient_lookahead(PATH), np.random.default_rng(0)
    for letters in ("etaoinshrdlu", "ab", "abcdefghijklmnopqrstuvwxyz", "thein"):
        for _ in range(3):
            word = "".join(rng.choice(list(letters), 4000))
            whole = v.symbols(word)
            merge(whole, v.pairs, v.size)
            assert list(transducer.encode_symbols(transducer._stream(word, v), v, far)) == [t for t in whole if t >= 0]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_components(docs, width, percent):
    sets = {}
    for d, t in docs:
        w = words(t)
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vocab = [f"W{i}" for i in range(3000)]
    docs = []
    for g in range(12):
        base = list(rng.choice(vocab, rng.integers(30, 200)))
        for _ in range(rng.integers(1, 9)):
            copy = list(base)
            for k in rng.integers(0, len(copy), rng.integers(0, max(2, len(copy) // 25))):
                copy[k] = str(rng.choice(vocab))
            docs.append((len(docs), " ".join(copy)))
    docs += [(900, ""), (901, "one two"), (902, "ONE two"), (903, " \n"), (904, docs[0][1]), (905, docs[0][1].replace(" ", "\t\n"))]
    df = spark.createDataFrame(docs + [(906, None)], "doc_id long, text string").withColumn("component", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, 3, 85).collect()}
    assert got.pop(906) == (0, 906)
    assert got == brute_components(docs, 3, 85)


def test_near_duplicates_edges(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 4 and all(r["kept"] for r in out) and sum(r["component_id"] is None for r in out) == 2
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2500, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(20, [float(v) for v in x[20]], 1), (40, [9.0] * 16, 1), (9000, None, 0), (9020, [0.0] * 16, 0), (9040, [float("nan")] * 16, 0), (9060, [1.0], 0), (None, [1.0] * 16, 0)]
    out = search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), lambda i: i % 20 == 0, k=20).toPandas()
    assert set(out["query_id"]) == set(range(0, 2500, 20))
    hits = []
    for q, g in out.groupby("query_id"):
        g = g.sort_values("rank")
        s = x.astype(float) @ x[q].astype(float)
        best = [i for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:20]
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g["score"], s[g["vec_id"]])
        hits.append(len(set(best) & set(g["vec_id"])) / 20)
    assert np.mean(hits) >= 0.9
    same = search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), lambda i: i % 20 == 0, k=20, exact=True).toPandas()
    for q, g in same.groupby("query_id"):
        s = x.astype(float) @ x[q].astype(float)
        assert g.sort_values("rank")["vec_id"].tolist() == [i for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:20]
    few = search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, label int"), lambda i: i == 0)
    assert sorted(few.toPandas()["vec_id"]) == [1, 2]
    assert search(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i == 0).count() == 0


@pytest.mark.parametrize("n", [300, 2600])
def test_neighbours_of_unequal_norms(spark, n):
    """Norms over three decades, at a size of one cell and above; columns with the names that the graph uses."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 24))
    x *= (10 ** rng.uniform(0, 3, n) / np.linalg.norm(x, axis=1))[:, None]
    x = x.astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in ("node", "id", "rank", "q", "cell", "side")})
    out = search(rows, lambda i: i % 20 == 0, k=20).toPandas()
    hits = []
    for q, g in out.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(np.argsort(-s)[:20]) & set(g["vec_id"])) / 20)
    assert len(hits) == n // 20 and np.mean(hits) >= 0.9


def test_classifier_learns_and_reads_whole_texts():
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(300):
        t = list(rng.choice(vocab, 80))
        labels.append(i % 4 == 0)
        if labels[-1]:
            t[int(rng.integers(80))] = str(rng.choice(["idiot", "scum"]))
        texts.append(" ".join(t))
    model = Classifier()
    rows, y = list(feature_rows(texts)), np.array(labels, dtype=int)
    model.fit(rows[:200], y[:200])
    model.calibrate(rows[:200], y[:200])
    assert ((model.scores(rows[200:]) >= 0.3) == y[200:]).mean() > 0.95
    late = list(feature_rows(["nice words " * 200_000 + "idiot", "nice words " * 200_000, ""]))
    s = model.scores(late)
    assert s[0] > s[1] and 0 <= s[2] <= 1


def test_thresholds_from_all_labels(spark, monkeypatch):
    """The sample that teaches is half toxic, the labels are 8 % toxic, and the only telling word is in clean rows too."""
    from tracehound.llm import toxicity

    monkeypatch.setattr(toxicity, "TRAIN_ROWS", {1: 100, 0: 100})
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(3000):
        toxic = i % 12 == 0
        telling = toxic or rng.random() < 0.25
        docs.append((i, " ".join(rng.choice(vocab, 12)) + (" idiot" if telling else "")))
        labels.append((i, int(toxic)))
    out = score_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = out.join(spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id").toPandas()
    # Calling everything clean makes 250 errors; taking each row with the word for toxic makes about 690.
    assert (out["predicted"] != out["toxic"]).sum() <= 270


def test_scores_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (2, None), (None, "b")], "doc_id long, text string").withColumn("toxic", F.lit("x"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = score_documents(docs, labels).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    assert score_documents(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the small tables")
def test_held_out_accuracy(spark):
    from tracehound.llm.queries import op4_toxicity

    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic")
    out = op4_toxicity(spark, data).join(labels, "doc_id").filter("held_out").toPandas()
    assert (out["predicted"] == out["toxic"]).mean() > 0.9


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the small tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns, name
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    assert len(out) and set(out["doc_id"]) <= {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_mix_stage_keeps_small_sources(spark, tmp_path):
    """A hot source beside small ones, and sources of a single document: none with a target loses all."""
    import corpus_pipeline

    docs = [(i, " ".join(["w"] * 90), "hot") for i in range(2000)] + [(3000 + i, " ".join(["w"] * 60), f"small{i % 20:02}") for i in range(600)] + [(5000 + i, " ".join(["w"] * 50), f"one{i:02}") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = corpus_pipeline.mix(spark, df, "").groupBy("source").count().toPandas().set_index("source")["count"]
    assert set(out.index) == {s for _, _, s in docs}
    even = [(i, " ".join(["w"] * 90), f"s{i % 30:02}") for i in range(30)]
    out = corpus_pipeline.mix(spark, spark.createDataFrame(even, "doc_id long, text string, source string"), "")
    assert {r["source"] for r in out.collect()} == {s for _, _, s in even}


def test_near_duplicates_in_a_large_bucket(spark, monkeypatch):
    """Hundreds of distinct copies of one text, and of texts near the similarity, above one block."""
    from tracehound.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 32)
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(4000)]
    base, docs = list(rng.choice(vocab, 150)), []
    for i in range(160):
        copy = list(base)
        for k in rng.choice(150, 4 if i < 80 else 9, replace=False):
            copy[k] = f"x{rng.integers(10**6)}"
        docs.append((i, " ".join(copy)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute_components(docs, 3, 85)


def test_near_duplicates_of_one_id(spark):
    """Different texts under one doc_id are different documents; a component's smallest id may have several."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a), (3, b + " end"), (1, a + " end"), (None, a), (4, "x" * 300_000)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 7 and {r["component_id"] for r in out} == {1, 4, None}
    # Two components of smallest id 1: the rows that a pipeline keeps are one of each, the one without id and the long one.
    assert sorted((r["doc_id"] or 0) for r in out if r["first"]) == [0, 1, 1, 4]
    assert sum(r["kept"] for r in out) == 5


ODD_DOCS = [
    (1, "a b c d e f g h", "en", "s1", 15), (1, "quite other words stand here now", "en", "s1", 33), (1, "a b c d e f g h", "en", "s1", 15), (None, "left without an id", "de", None, 18), (None, "left without an id", "de", None, 18),
    (None, None, None, None, None), (2, None, "en", "s2", None), (3, "", "en", "s2", 0), (4, "x" * 300_000, "fr", "s3", 300_000), (5, "A B c d e f g h", "en", "s1", 15), (6, "words\n" * 400, None, "s3", 2400), (7, "one two three four five six", "es", "s4", 27),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage_rows(spark, tmp_path, name, docs):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    return out.columns, sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "near_dedup", "mixing"])
def test_stages_on_odd_rows(spark, tmp_path, name):
    """Nulls everywhere, repeated rows and ids, empty and long texts, columns that clash with the operators' own."""
    clashing = ["size", "taken", "target", "component_id", "kept", "first", "text_key", "score", "n_removed", "tie", "copies"]
    docs = spark.createDataFrame(ODD_DOCS, ODD_SCHEMA).withColumns({c: F.lit(c) for c in clashing}).withColumn("m", F.create_map(F.lit("k"), F.col("lang")))
    columns, rows = stage_rows(spark, tmp_path, name, docs)
    assert columns == docs.columns and all(r[5:-1] == tuple(clashing) for r in rows)
    assert rows == stage_rows(spark, tmp_path, name, docs.repartition(3))[1]
    got = sorted((r[:5] for r in rows), key=str)
    if name == "toxicity":
        assert got == sorted(ODD_DOCS, key=str)
    elif name == "line_dedup":
        # Of 400 equal lines the first three stay.
        assert len(got) == len(ODD_DOCS) and {r[1] for r in got if r[0] == 6} == {"words\nwords\nwords\n"}
        assert [r for r in got if r[0] != 6] == sorted((r for r in ODD_DOCS if r[0] != 6), key=str)
    elif name == "near_dedup":
        # The repeated row and the one of 5 are copies; both texts of id 1 stay, and so does every row without id.
        assert got == sorted([r for i, r in enumerate(ODD_DOCS) if i not in (2, 9)], key=str)
    else:
        assert {r for r in got if not r[1]} == {r for r in ODD_DOCS if not r[1]} and set(got) <= set(ODD_DOCS)
        for r in set(got):
            assert got.count(r) <= 2 * ODD_DOCS.count(r)
    empty = spark.createDataFrame([], ODD_SCHEMA)
    assert stage_rows(spark, tmp_path, name, empty) == (empty.columns, [])


def test_tokens_of_odd_rows(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(ODD_DOCS, ODD_SCHEMA).withColumn("n_tokens", F.lit("x"))
    out = corpus_pipeline.tokens(spark, docs, "").collect()
    assert len(out) == len(ODD_DOCS) and {r["n_tokens"] for r in out if r["doc_id"] in (2, 3)} == {0}
    assert corpus_pipeline.tokens(spark, docs.limit(0), "").count() == 0


def test_short_words_merge_as_long_ones_and_frequent_strings_stay():
    import random

    import public_tokenizers

    from tracehound.llm.bpe import merge, merged_short, vocabulary
    from tracehound.llm.token_counts import Kept

    v, rng = vocabulary(public_tokenizers.path("word_bpe_49k.json")), random.Random(3)
    for _ in range(2000):
        symbols = v.symbols("".join(rng.choice("aaabetinosr") for _ in range(rng.randint(1, 30))))
        by_heap = symbols.copy()
        merge(by_heap, v.pairs, v.size)
        assert merged_short(symbols, v.pairs, v.size) == [t for t in by_heap if t >= 0]
    made = []
    kept = Kept(lambda s: (made.append(s), len(s))[1], 100)
    for i in range(1000):
        assert kept["often"] == 5 and kept[f"r{i}"] == len(f"r{i}")
        assert len(kept) + len(kept.older) <= 100
    assert made.count("often") == 1


def test_words_merged_in_step(monkeypatch):
    """Many words at once give the tokens of one after another, and digests do not depend on lots or on what is kept."""
    import random
    from array import array

    from tracehound.llm.bpe import merged_many

    rng, v = random.Random(11), vocabulary(PATH)
    words = ["".join(rng.choice("aabcdeehinorst'.!é1ßЖ") for _ in range(rng.randint(1, 40))) for _ in range(800)] + ["a" * k for k in range(1, 30)]
    tokens, ends = merged_many(words, v)
    for word, start, end in zip(words, [0, *ends.tolist()], ends.tolist()):
        symbols = v.symbols(word)
        merge(symbols, v.pairs, v.size)
        assert tokens[start:end].tolist() == [t for t in symbols if t >= 0]
    assert len(merged_many([], v)[0]) == 0
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)] + ["", "  ", "x" * 90 + " the\n\nthe <|endoftext|>the", "Ꟛ" * 50]
    plain = [b"".join(transducer.encoder(PATH).encode(t)) for t in texts]
    want = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(" ".join(v.strings[i] for i in array("I", ids)).encode()).hexdigest()) for ids in plain]
    assert list(transducer.Digester(PATH).digests(texts)) == want
    monkeypatch.setattr(transducer, "LOT", 50)
    monkeypatch.setattr(transducer, "KEPT_WORDS", 20)
    assert list(transducer.Digester(PATH).digests(texts)) == want
