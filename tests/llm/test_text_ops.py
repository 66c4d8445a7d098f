"""Fingerprints, line dedup, sharding, URL filters and mixing on small tables, against plain Python."""

import hashlib
import math
import os
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracehound.llm.fingerprints import canonical_text, fingerprint_documents, with_next
from tracehound.llm.line_dedup import dedup_lines
from tracehound.llm.mixing import highest_quotients, mix_sources, with_targets
from tracehound.llm.sharding import difference, shard_documents
from tracehound.llm.url_filters import match_urls

ODD = ["", None, "  a  B\t\nc ", "A b C", "é", "é", "한", "한", "x" * 200_000, "Straße", "STRASSE"]


def plain(t):
    return " ".join(unicodedata.normalize("NFC", t or "").lower().replace("ß", "ss").replace("ς", "σ").split())


def test_fingerprints_follow_canonical_text(spark):
    df = spark.createDataFrame(list(enumerate(ODD)) + [(None, "A b C")], "doc_id long, text string").withColumn("canonical", F.lit(1))
    rows = fingerprint_documents(df).collect()
    assert len(rows) == len(ODD) + 1
    by = {r["doc_id"]: r["fingerprint"] for r in rows}
    for i, a in enumerate(ODD):
        for j, b in enumerate(ODD):
            assert (by[i] == by[j]) == (plain(a) == plain(b)), (i, j)
    assert fingerprint_documents(df.limit(0)).count() == 0


def test_composition_matches_the_database(spark):
    rng = np.random.default_rng(1)
    pools = [range(0x41, 0x250), range(0x300, 0x345), range(0x1E00, 0x2000), range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3), range(0xAC00, 0xD7A4)]
    texts = ["a" + "".join(chr(rng.choice(pools[rng.integers(len(pools))])) for _ in range(10)) for _ in range(60)]
    df = spark.createDataFrame([(i, unicodedata.normalize("NFD", t), unicodedata.normalize("NFC", t)) for i, t in enumerate(texts)], "i long, d string, c string")
    assert df.filter(canonical_text(F.col("d")) != canonical_text(F.col("c"))).count() == 0


def test_next_wraps_around_and_crosses_ranges(spark):
    ids = [5, 1, 9, -3, 700, 44, 44]
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    rows = with_next(df, ("text",)).collect()
    ordered = sorted(rows, key=lambda r: (r["doc_id"], r["tie"]))
    assert [r["next_text"] for r in ordered] == [r["text"] for r in ordered[1:] + ordered[:1]]
    assert with_next(df.limit(0), ("text",)).count() == 0


def brute_lines(docs):
    first, covered = {}, defaultdict(set)
    for d, t in sorted(docs):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(x.strip(" ") for x in lines[p : p + 3])
            if any(w):
                d0, p0 = first.setdefault(w, (d, p))
                if (d0, p0) != (d, p):
                    covered[d] |= {q for q in range(p, p + 3) if d0 != d or q >= p0 + 3}
    return {d: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in covered[d]) for d, t in docs}


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = [(i, "\n".join(rng.choice(list("abcd "), rng.integers(1, 14)))) for i in range(60)] + [(100, "a\na\na\na\na\na\na"), (101, "")]
    df = spark.createDataFrame(docs + [(102, None)], "doc_id long, text string").withColumn("removed", F.lit("x"))
    got = {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()}
    assert got.pop(102) is None
    assert got == brute_lines(docs)
    assert dedup_lines(df.limit(0)).count() == 0


def test_long_passages_of_few_lines(spark):
    long, halves, short = " ".join(f"w{i}" for i in range(51)), [" ".join(f"{c}{i}" for i in range(26)) for c in "uv"], " ".join(f"s{i}" for i in range(50))
    docs = [(1, f"a\n{long}\nb"), (2, f" {long} "), (3, f"c\n{long}\nd"), (4, "\n".join(["e", *halves, "f"])), (5, "\n".join(halves)), (6, "\n".join(["g", *halves])), (7, short), (8, short), (9, f"{long}x\n{halves[0]}")]
    docs += [(10, f"k\n{long}z\nl\n{long}z")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(df, long_words=50).collect()}
    assert got == dict(docs) | {2: "", 3: "c\nd", 5: "", 6: "g", 10: f"k\n{long}z\nl"}
    assert {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()} == dict(docs)


def test_equal_rows_are_one_document_for_line_dedup(spark):
    df = spark.createDataFrame([(1, "p\nq\nr"), (1, "p\nq\nr"), (None, "s\nt\nu")], "doc_id long, text string")
    assert sorted(r["text"] for r in dedup_lines(df).collect()) == ["p\nq\nr", "p\nq\nr", "s\nt\nu"]


def test_differencing_places_all_and_balances():
    sizes = np.random.default_rng(0).lognormal(7, 1, 500).astype(int)
    sums = np.bincount(difference(sizes, 8), weights=sizes, minlength=8)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() < 10
    two = np.bincount(difference(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])
    assert sorted(two) == [14, 16]  # the known result of differencing on this list


@pytest.mark.parametrize("block", [64, 4096])
def test_sharding(spark, block):
    rng = np.random.default_rng(5)
    docs = [(i, "w" * int(rng.integers(0, 4000))) for i in range(1500)] + [(2000 + i, "same text") for i in range(700)] + [(None, None), (7, "again")]
    out = shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), block_items=block).toPandas()
    assert len(out) == len(docs) and set(out["shard"]) == set(range(8))
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    same = out[out["doc_id"].between(2000, 2699)]
    assert same["shard"].nunique() == 1
    sums = out.groupby("shard")["size"].sum()
    assert sums.max() < 1.02 * sums.mean()


def test_sharding_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shard_documents(empty).count() == 0
    one = shard_documents(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0]
    assert (one["size"], one["text_crc32"], one["slot"], one["law"]) == (1, 0, 0, "bytes")


def test_urls_against_brute_force(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("com", "/en/74", "block"), ("net", "", "block"), ("a.net", "/x", "allow"), (None, "/", "block")]
    hosts, paths = ["example.com", "www.EXAMPLE.com", "xcom", "com", "a.net", "b.a.net", "org", ""], ["", "/", "/en/", "/en/7", "/en/75", "/en/74/x", "/x", "/fr?q=/en/", "/en#a"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "no scheme", "ftp://u@h:1/x", "http://a.net/x?http://com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumn("host", F.lit(3))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in match_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert got[i] == (host, path, best[2], best[3]), url


def test_url_tables_may_be_empty(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert match_urls(pages, none).collect()[0]["verdict"] == "allow"
    assert match_urls(pages.limit(0), none).count() == 0


def test_highest_quotients_against_playing_all_seats():
    rng = np.random.default_rng(2)
    for _ in range(300):
        k = rng.integers(1, 7)
        w, most, seats = rng.integers(0, 40, k).astype(float), rng.integers(0, 20, k), int(rng.integers(0, 50))
        got = np.zeros(k, dtype=int)
        for _ in range(min(seats, most[w > 0].sum())):
            got[np.argmax(np.where((got < most) & (w > 0), w / (2 * got + 1), -1))] += 1
        assert (highest_quotients(w, seats, most) == got).all()


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([(100, 0), (10, 1), (10, 2), (0, 3)], "source_size long, rank long")
    t = [r["target"] for r in with_targets(sizes, (1, 5, 2), 1.5, 2).orderBy("rank").collect()]
    assert sum(t) == pytest.approx(180) and t[1:] == [20, 20, 0]
    assert with_targets(sizes.limit(0), (1, 5, 2), 1.5, 2).count() == 0


def brute_mix(docs, seed=17):
    """The whole mix by plain loops, for sources of one shard each and distinct doc_ids."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    names = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d] for d, _, x in docs if x == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), list(names)
    while True:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= 2 * total[s]]
        if not over:
            break
        target |= {s: 2 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    block = min(max(min(n for n in total.values() if n) // 1000, 1), 64)
    seats, most = dict.fromkeys(names, 0), {s: 2 * total[s] // block + (total[s] > 0) for s in names}
    for _ in range(round(1.5 * sum(total.values()) / block)):
        best = max((s for s in names if seats[s] < most[s]), key=lambda s: target[s] / (2 * seats[s] + 1))
        seats[best] += 1
    out = {}
    for s in names:
        n = max(1, -(-total[s] // block))
        quota = min(seats[s], 2 * -(-total[s] // block))
        step, shift = 1 + zlib.crc32(f"{seed}:{s}:0:step".encode()) % n, zlib.crc32(f"{seed}:{s}:0:shift".encode())
        while math.gcd(step, n) > 1:
            step += 1
        times = [quota // n + ((j * step + shift) % n < quota % n) for j in range(n)]
        at = 0
        for d, _, _ in sorted((x for x in docs if x[2] == s), key=lambda x: x[0]):
            out[d] = (size[d], total[s], pytest.approx(target[s]), sum(times[w // block] for w in range(at, at + size[d])))
            at += size[d]
    return out


def test_mix_against_brute_force(spark, tmp_path):
    """op10 on a small table: every column of every row."""
    from tracehound.llm.queries import op10_mixing

    rng = np.random.default_rng(14)
    docs = [(i, " ".join(["w"] * int(rng.integers(0, 40))), f"s{i % 5}" if i % 9 else None) for i in range(160)] + [(900, None, "s1"), (901, "", "zz"), (902, "\u00e9 \u3000x", "\U0001f600")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "copies": F.lit(1), "shard": F.lit(2)}).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in op10_mixing(spark, str(tmp_path)).collect()}
    assert got == brute_mix(docs)


def test_mix_of_equal_rows(spark, monkeypatch):
    """A row that makes up most of the table, in many lots and shards, and seats dealt in more than one group."""
    from tracehound.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_WORDS", 400)
    monkeypatch.setattr(mixing, "DEALT_TOGETHER", 3)
    monkeypatch.setattr(mixing, "LOT", 50)
    docs = [(None, "a b c", "s1")] * 3000 + [(7, "a b", "s1")] * 200 + [(i, "w " * 30, f"t{i % 11:02}") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out, again = (mix_sources(x).toPandas() for x in (df, df.repartition(5)))
    key = lambda d: sorted(map(tuple, d.astype(str).to_numpy()))
    assert len(out) == len(docs) and key(out) == key(again)
    assert (out["taken"] <= 2 * out["size"]).all()
    for _, g in out.groupby(["source_size", "target"]):
        # A dozen sources, some of equal size and target.
        assert abs(g["taken"].sum() - g["target"].iloc[0] * (g["size"].sum() / g["source_size"].iloc[0])) <= 0.05 * g["taken"].sum() + 30


@pytest.mark.parametrize("whole", [False, True])
def test_mix(spark, whole):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(["w"] * int(rng.integers(0, 300))), f"s{i % 7}" if i % 9 else None) for i in range(1200)] + [(5000, None, "s1"), (5001, "", "zz"), (None, "a b", "s1"), (3, "w w", "s3")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mix_sources(df, whole=whole, block_words=64 if whole else 0).toPandas()
    again = mix_sources(df.repartition(3), whole=whole, block_words=64 if whole else 0).toPandas()
    key = lambda d: sorted(map(tuple, d.astype(str).to_numpy()))
    assert key(out) == key(again) and len(out) == len(docs)
    assert (out["taken"] <= 2 * out["size"]).all() and (out["taken"] >= 0).all()
    taken = out.groupby(["source_size", "target"])["taken"].sum()
    assert len(taken) == 9
    for (_, target), got in taken.items():
        assert abs(got - target) <= max(2000 if whole else 30, 0.02 * target)
    assert mix_sources(df.limit(0)).count() == 0


def brute_edited(docs):
    ordered, out = [(d, t or "") for d, t in sorted(docs, key=lambda x: x[0])], {}
    for i, (d, t) in enumerate(ordered):
        k, after = len(t) // 2, ordered[(i + 1) % len(ordered)][1]
        e = t[: len(t) - k] + after[:k]
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), float(plain(t) == plain(e)), float(plain(t) == plain(after)))
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_op1_against_brute_force(spark, tmp_path, monkeypatch, weak):
    """Every column but the fingerprints themselves, which must be equal where canonical texts are; also with a hash of
    16 values, so that nearly all texts collide, edited ones with others too."""
    from tracehound.llm import fingerprints, queries

    if weak:
        monkeypatch.setattr(queries, "wide_hash", lambda c: F.substring(F.hex(F.xxhash64(c)), 1, 1))
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 64)
    docs = [(3, "abcdef"), (1, "xy"), (7, None), (9, "\U0001f600bcd"), (12, "Same text"), (13, "same  TEXT"), (14, "aa"), (15, "aa"), (16, "q" * 5000), (17, ""), (40, "abab"), (41, "ab"), (-5, "caf\u00e9"), (50, "cafe\u0301 CAFE\u0301")]
    docs += [(100 + i, f"text number {i % 17} of {i % 5}") for i in range(60)]
    clash = {c: F.lit(c) for c in ("fingerprint", "check", "tie", "next_text", "canonical", "edited", "number")}
    spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op1_fingerprints(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in rows} == brute_edited(docs)
    texts = dict(docs)
    by = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert all((by[a] == by[b]) == (plain(texts[a]) == plain(texts[b])) for a in by for b in by)


def test_op1_of_an_empty_table(spark, tmp_path):
    from tracehound.llm.queries import op1_fingerprints

    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op1_fingerprints(spark, str(tmp_path)).count() == 0


def test_sharding_near_the_optimum(spark):
    """Small sets, every way of dealing tried: differencing in one block is within a few percent of the best."""
    from itertools import product

    rng = np.random.default_rng(11)
    for _ in range(8):
        sizes = rng.integers(1, 60, 8)
        best = min(max(np.bincount(ways, weights=sizes, minlength=3)) for ways in product(range(3), repeat=8))
        assert np.bincount(difference(sizes, 3), weights=sizes, minlength=3).max() <= 1.2 * best
    docs = [(i, "w" * int(n)) for i, n in enumerate(sizes)] + [(99, "long " * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("id", "size", "shard", "cell", "slot", "at")})
    out = shard_documents(df).toPandas()
    assert sorted(out["size"]) == sorted(len(t) + 1 for _, t in docs)
    assert all(r.text_crc32 == zlib.crc32(dict(docs)[r.doc_id].encode()) for r in out.itertuples())
    assert out.loc[out["doc_id"] == 99, "slot"].tolist() == [0] and (out.groupby("shard")["doc_id"].count() > 0).all()


def test_a_window_in_a_third_of_all_rows(spark):
    """A passage that stands in every third document, and a text of many lines."""
    docs = [(i, f"own {i}\np\nq\nr\nend {i}" if i % 3 == 0 else f"x{i}\ny{i}\nz{i}") for i in range(300)] + [(500, "\n".join(f"line {i}" for i in range(30_000)))]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(docs) | {i: f"own {i}\nend {i}" for i in range(3, 300, 3)}


@pytest.mark.parametrize("keys", [3, 100_000])
def test_urls_in_many_sweeps(spark, monkeypatch, keys):
    from tracehound.llm import url_filters

    monkeypatch.setattr(url_filters, "SWEEP_KEYS", keys)
    rules = [("com", "/a", "block"), ("com", "/a/b", "allow"), ("x.com", "/", "block"), ("x.com", "/a/b/c", "allow"), ("org", "", "block")]
    urls = [f"http://{h}/{p}" for h in ("com", "x.com", "y.x.com", "z.org", "net") for p in ("", "a", "a/b", "a/b/c", "a/b/cd", "a/z", "b")] + [None] * 40
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit(c) for c in ("key", "sweep", "stack", "open", "best")})
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in match_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, _, path = (url or "://").split("://")[1].partition("/")
        path = "/" + path if url else ""
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert got[i] == (best[2], best[3]), url


def test_many_hosts_with_one_path_are_swept_once(spark, monkeypatch):
    from tracehound.llm import url_filters

    monkeypatch.setattr(url_filters, "SWEEP_KEYS", 50)
    pages = [(i, f"http://h{i}.shop{i % 7}.com/{'en/' if i % 2 else ''}") for i in range(2000)] + [(5000 + i, f"http://a.org/{i}") for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    rules = spark.createDataFrame([("com", "/en/", "block"), ("shop3.com", "/", "allow"), ("org", "/1", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: r["rule"] for r in match_urls(df, rules).collect()}
    for i, url in pages:
        host, path = url[7:].split("/", 1)
        fit = [h + p for h, p in (("com", "/en/"), ("shop3.com", "/"), ("org", "/1")) if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        assert got[i] == max(fit, key=len, default=None)


def test_rows_without_words_are_many_shards(spark, monkeypatch):
    from tracehound.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_ROWS", 100)
    seen = {}
    real = mixing.staged
    monkeypatch.setattr(mixing, "staged", lambda df, label, *a, **b: seen.setdefault(label, real(df, label, *a, **b)) if label == "mix-placed" else real(df, label, *a, **b))
    docs = [(i, "" if i % 50 else "w " * 30, "s") for i in range(2500)]
    out = mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    largest = seen["mix-placed"].groupBy("shard").count().agg(F.max("count"), F.count("*")).first()
    assert largest[0] < 300 and largest[1] == 25
    assert len(out) == 2500 and all(r["taken"] <= 2 * r["size"] for r in out) and abs(sum(r["taken"] for r in out) - 1.5 * 1500) < 100


def test_one_row_repeated_is_many_cells(spark, monkeypatch):
    from tracehound.llm import sharding

    monkeypatch.setattr(sharding, "LOT", 50)
    docs = [(None, "same")] * 3000 + [(i, f"t{i}") for i in range(3000)]
    seen = {}
    real = sharding.staged
    monkeypatch.setattr(sharding, "staged", lambda df, label, *a, **b: seen.setdefault(label, real(df, label, *a, **b)) if label == "shard-placed" else real(df, label, *a, **b))
    out = shard_documents(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    assert len(out) == 6000 and out[out["doc_id"].isna()]["shard"].nunique() == 1
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert seen["shard-placed"].groupBy("shard", "cell").agg(F.sum("copies").alias("n")).agg(F.max("n")).first()[0] < 1800


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    from tracehound.llm.queries import URL_RULES, op5_url_filters

    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert ", ".join(f"{verdict} {host}{path}" for host, path, verdict in URL_RULES) == contract
    pages = [(1, "http://a.net/de/1", "net/de/", "allow"), (2, "http://example.net/de/81", "example.net/de/8", "block"), (3, "http://example.net/de/7", "net/de/", "allow"), (4, "http://a.com/en/7", "com/en/", "block")]
    spark.createDataFrame([p[:2] for p in pages], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in op5_url_filters(spark, str(tmp_path)).collect()) == [(i, rule, verdict) for i, _, rule, verdict in pages]
