"""Substring search by trigrams reads few blocks and finds what a plain search finds; redaction without Python."""

import random

from pyspark.sql import functions as F

from tracehound.operators import redaction as X
from tracehound.operators.hunt import Hunt
from tracehound.operators.text_index import TextIndex, pieces_of, trigrams
from tracehound.sources.collection import SCHEMA


def test_trigrams(spark):
    df = spark.createDataFrame([("Abcabc",), ("ab",), ("",), (None,), ("é\U0001f600x",), ("z" * 50_000,)], "t string")
    got = [sorted(r[0]) for r in df.select(trigrams(F.col("t"))).collect()]
    assert got == [["abc", "bca", "cab"], [], [], [], ["é\U0001f600x"], ["zzz"]] and pieces_of("AbcA") == ["abc", "bca"]


def test_index_against_plain_search(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abAB \\%_.") for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["needle in Hay"] * 3 + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    index = TextIndex.build(df, F.col("text"), blocks=50)
    for needle in ("needle", "NEEDLE in", "ab", "aba", "%_.", "\\a", "zzz", "b", "abab "):
        assert sorted(r["i"] for r in index.search(needle).collect()) == [i for i, t in enumerate(texts) if t is not None and needle.lower() in t.lower()]
    assert len(index.blocks_with("needle")) == 1 and index.blocks_with("zzz") == [] and index.blocks_with("ab") is None
    plan = index.search("needle")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__block" in plan or "__block" in plan.split("PartitionFilters")[1][:200]
    # Another session opens it by its folder.
    assert TextIndex(spark, index.path, "__text").search("needle").count() == 3


def test_hunt_by_index(spark):
    rows = spark.createDataFrame([("h", "pslist", i, "f", {"Name": f"p{i}", "x": "needle" if i == 3 else ""}) for i in range(70)] + [("h", "dns", 0, "f", {"q": "Needle"})], SCHEMA)
    hunt = Hunt(rows)
    plain, by_index = hunt.frequency("needle").first(), hunt.indexed(blocks=8).frequency("needle").first()
    assert plain == by_index and plain["artifacts"] == ["dns", "pslist"] and hunt.indexed(blocks=8).search("p1", None).count() == 11
    assert hunt.slice("pslist", 5, None).count() == 65 and hunt.slice("pslist", 0, 60).count() == 60


def test_replacement_is_one_pass_and_longest_first(spark):
    rows = spark.createDataFrame([(1, "a.b a.bc x\\Ey $1 a"), (2, "none"), (3, None), (4, ""), (5, "a.ba.b")], "k int, t string")
    pairs = {"a.b": "a.bc", "a.bc": "[2]", "x\\Ey": "$1\\", "$1": "Q", "axb": "never"}
    own = spark.createDataFrame([(k, [(a, b) for a, b in pairs.items()]) for k in (1, 3, 4, 5)], "k int, pairs array<struct<a:string,b:string>>")
    got = {r["k"]: r["o"] for r in X._replace(own, rows, "k", "t", "o").collect()}
    assert got == {1: "a.bc [2] $1\\ Q a", 2: "none", 3: None, 4: "", 5: "a.bca.bc"}


def test_copies_of_a_text_are_redacted_once(spark, monkeypatch):
    met = []
    real = X.candidates
    monkeypatch.setattr(X, "candidates", lambda rows, *a, **b: (met.append(rows.count()), real(rows, *a, **b))[1])
    texts = ["mail a@b.cz and 10.0.0.1", "nothing", None]
    df = spark.createDataFrame([(i, texts[i % 3]) for i in range(300)], "i long, text string")
    hidden, mapping = X.redact(df, "i", "text")
    shown = {r["i"]: r["redacted"] for r in hidden.collect()}
    assert met == [3] and len(shown) == 300 and all(shown[i] == ("mail [EMAIL_1] and [PRIVATE_IP_1]", "nothing", None)[i % 3] for i in shown)
    back = {r["i"]: r["restored"] for r in X.restore(hidden.select("i", "redacted"), "i", "redacted", mapping).collect()}
    assert back == {i: texts[i % 3] for i in range(300)}


def test_pieces_of_a_block(monkeypatch):
    """The pieces of many texts side by side are those of each by itself; none reaches over an end, whatever the lots."""
    from tracehound.operators import text_index as T

    rng = random.Random(8)
    texts = ["", "q", "wxyz", *("".join(rng.choice("ab\0é\U0001f600") for _ in range(rng.randint(0, 12))) for _ in range(50)), "", "x", "xy", "vwxyz"]
    want = sorted({p for t in texts for p in pieces_of(t)})
    for lot in (1 << 20, 7, 1):
        monkeypatch.setattr(T, "LOT", lot)
        assert sorted(T._distinct(texts)) == want and T._distinct([]) == T._distinct(["", "ab", "c"]) == []
