"""Quality rules: features and estimates against plain Python, and the verdict on labelled documents."""

import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracehound.llm import quality as Q
from tracehound.llm.queries import op11_quality_rules

DATA = "/root/testdata/sf0.01"


def plain_features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_capitals": len(re.findall("[A-Z]", text)), "n_shouts": text.count("!"), "n_marks": len(re.findall(r"[!-/:-@\[-`{-~]", text)),
        "n_ends": sum(w[-1] in ".!?" for w in words), "n_small_words": sum(len(w) <= 3 and not re.search(r"[#*$%&|<>]", w) for w in words), "n_distinct": len(set(words)),
    }


def odd_texts():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 40))) for _ in range(80)]
    texts += ["\n".join(rng.choice(["a b", "c", " ", "a b ", ""], rng.integers(0, 12))) for _ in range(30)]
    return texts + [None, "", " \n\t ", "ünï \U0001f600 cödé x", "# * | <b> 100%!! A.B? {x}~", "one two three four five " * 9, "w" * 200_000, " ".join(map(str, range(30_000))) + " a b c d e a b c d e"]


def test_features_against_plain_python(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "__words": F.lit(1)})
    rows = {r["doc_id"]: r.asDict() for r in Q.features(df).collect()}
    assert {i: {k: v for k, v in r.items() if k != "doc_id"} for i, r in rows.items()} == {i: plain_features(t) for i, t in enumerate(texts)}
    assert Q.features(df.limit(0)).count() == 0


def plain_estimate(codes, n_rules):
    """The same estimate with numpy over single documents."""
    votes = np.array([[c // 3**k % 3 for k in range(n_rules - 1, -1, -1)] for c in codes])
    share, right = Q.FIRST_SHARE, np.full(n_rules, Q.FIRST_ACCURACY)

    def posterior():
        odds = np.log(right / (1 - right))
        return 1 / (1 + np.exp(-(math.log(share / (1 - share)) + (votes == 1) @ odds - (votes == 2) @ odds)))

    for _ in range(Q.ROUNDS):
        q = posterior()[:, None]
        correct = ((votes == 1) * q + (votes == 2) * (1 - q)).sum(axis=0)
        right = np.clip((correct + Q.FIRST_WEIGHT * Q.FIRST_ACCURACY) / ((votes > 0).sum(axis=0) + Q.FIRST_WEIGHT), Q.LEAST_ACCURACY, Q.MOST_ACCURACY)
        share = (q.sum() + Q.FIRST_WEIGHT * Q.FIRST_SHARE) / (len(q) + Q.FIRST_WEIGHT)
    return share, right, posterior()


def test_estimates_against_numpy(spark):
    rules = Q.RULES[:4]
    codes = [int(c) for c in np.random.default_rng(6).choice(81, 400, p=np.random.default_rng(7).dirichlet(np.full(81, 0.2)))]
    one = Q.estimated_rules(spark.createDataFrame([(c,) for c in codes], "code long"), rules).collect()[0]
    share, right, _ = plain_estimate(codes, 4)
    assert one["state"]["share"] == pytest.approx(share) and one["state"]["right"] == pytest.approx(list(right))
    assert {(p["code"], p["n"]) for p in one["patterns"]} == set(Counter(codes).items())


def test_query_against_plain_python(spark, tmp_path):
    texts = odd_texts()
    docs = [*enumerate(texts), (None, texts[3]), (5, texts[5])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"kept": F.lit("clash"), "probability": F.lit(2)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_quality_rules(spark, str(tmp_path)).collect()
    rows = [plain_features(t) for _, t in docs]
    as_code = lambda f: int("".join("2" if vote(bad, f) else "1" if vote(good, f) else "0" for _, good, bad in Q.RULES), 3)
    vote = lambda rule, f: eval(rule.replace("false", "False").replace(" = ", " == "), {}, f)  # noqa: E731, S307
    _, _, posterior = plain_estimate([as_code(f) for f in rows], len(Q.RULES))
    wanted = []
    for (doc_id, _), f, q in zip(docs, rows, posterior):
        failed = f["n_words"] < 10 or 100 * f["n_repeat_words"] > 20 * f["n_words"]
        wanted.append((doc_id, f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"], failed, not failed and bool(q >= 0.5)))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(wanted, key=key)


def test_an_empty_table(spark):
    assert Q.score_quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the supplied tables")
def test_verdict_on_labelled_documents(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = Q.score_quality(docs).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    good, bad = n.get((1, True), 0) / (n.get((1, True), 0) + n.get((1, False), 0)), n.get((0, False), 0) / (n.get((0, False), 0) + n.get((0, True), 0))
    assert good > 0.99 and bad > 0.9
