"""Near-duplicate documents: universal hash minima, banding, verification on whole shingle sets, components.

Documents with equal shingle sets are one node. Nodes that agree on a band of minima meet in a bucket. A bucket of m
nodes is not turned into its m * m pairs: first each node is compared with the bucket's leader, then, in blocks, with the
few nodes whose minima agree most with its own; groups of copies collapse into components by that. Buckets that stay
divided are then compared in blocks as a whole. Signatures always come first: pairs that agree on too few minima are
dropped, and so are pairs for which bitmaps of the sets prove too small an intersection. What is left is verified on
the sets. Only the texts of nodes that share a bucket are ever moved.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.operators.components import connected_components

from .shared import discard, near, staged, text_or_empty
from .words import documents_words, mix

BANDS, ROWS = 28, 4
#: Standard deviations below the similarity at which the share of equal minima drops a pair: odds of 6e-8.
DEVIATIONS = 5.3
#: Partners of a node that are tried in a block before all are.
BEST = 4
#: Nodes of one bucket that are compared with one another in one task.
BLOCK = 1024
#: Shingles in one run of minima.
RUN = 1 << 15

_RNG = np.random.default_rng(7)
_PLACE = _RNG.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _RNG.integers(1, 2**62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingles; fewer words than width are one shingle, no words none."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        s = np.array([(words * _PLACE[:n]).sum(dtype=np.uint64) ^ np.uint64(n)])
    else:
        s = words[: n - width + 1] * _PLACE[0]
        for k in range(1, width):
            s = s + words[k : n - width + 1 + k] * _PLACE[k]
    return np.unique(mix(s))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of BANDS * ROWS multiply-shift hashes over each (non-empty) set, as 32-bit numbers."""
    out = np.empty((len(sets), BANDS * ROWS), dtype=np.uint32)
    low = 0
    while low < len(sets):
        high, n = low, 0
        while high < len(sets) and (high == low or n + len(sets[high]) <= RUN):
            n += len(sets[high])
            high += 1
        values = np.concatenate(sets[low:high])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[low : high - 1]])]).astype(np.int64)
        for k in range(BANDS * ROWS):
            out[low:high, k] = np.minimum.reduceat((values * _FACTOR[k] + _SHIFT[k]) >> np.uint64(32), starts)
        low = high
    return out


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each shingle, at least four places a shingle; their number is a power of two."""
    size = max(64, 1 << (4 * len(s) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _signature(text: Column, width: int) -> Column:
    """(n_shingles, set_key, minima, bits) of a text; the minima are 16-bit numbers, those of a band side by side."""

    @F.pandas_udf("n_shingles long, set_key binary, minima binary, bits binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(words, width) for some in documents_words(texts) for words in some]
            full = [s for s in sets if len(s)]
            m = iter((minima(full) & 0xFFFF).astype("<u2") if full else ())
            rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), next(m).tobytes(), bitmap(s)) if len(s) else (0, None, None, None) for s in sets]
            yield pd.DataFrame(rows, columns=["n_shingles", "set_key", "minima", "bits"])

    return run(text)


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def agreement(percent: int) -> float:
    """The share of equal minima under which a pair is dropped."""
    p = percent / 100
    return p - DEVIATIONS * math.sqrt(p * (1 - p) / (BANDS * ROWS))


def least_common(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection with which sets of sizes n and m reach the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def may_link(a: pd.DataFrame, b: pd.DataFrame, percent: int, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Positions (in a, in b) of pairs in different components that sizes, minima and bitmaps allow to be linked; with
    `most`, of each in a those with the so many in b whose minima agree best."""
    na, nb = a["n_shingles"].to_numpy(dtype=np.int64), b["n_shingles"].to_numpy(dtype=np.int64)
    ca, cb = a["component"].to_numpy(), b["component"].to_numpy()
    ma = np.stack([np.frombuffer(x, dtype="<u2") for x in a["minima"]])
    mb = np.stack([np.frombuffer(x, dtype="<u2") for x in b["minima"]])
    bits_b = [np.frombuffer(x, dtype=np.uint8) for x in b["bits"]]
    folded: dict[int, dict[int, np.ndarray]] = {}
    agree = agreement(percent)
    for i in range(len(a)):
        need = least_common(na[i], nb, percent)
        j = np.flatnonzero((cb != ca[i]) & (need <= np.minimum(na[i], nb)))
        share = (mb[j] == ma[i]).mean(axis=1) if len(j) else np.empty(0)
        j, share = j[share >= agree], share[share >= agree]
        if not len(j):
            continue
        if most is not None:
            j = j[np.argsort(-share, kind="stable")[:most]]
        own = np.frombuffer(a["bits"].iloc[i], dtype=np.uint8)
        for size in {min(len(own), len(bits_b[k])) for k in j}:
            k = j[[min(len(own), len(bits_b[x])) == size for x in j]]
            if size not in folded:
                folded[size] = {}
            for x in k:
                if x not in folded[size]:
                    folded[size][x] = _fold(bits_b[x], size).view(np.uint64)
            other, mine = np.stack([folded[size][x] for x in k]), _fold(own, size).view(np.uint64)
            # Every bit of one that the other lacks is a shingle that is not common.
            largest = np.minimum(na[i] - np.bitwise_count(mine & ~other).sum(axis=1, dtype=np.int64), nb[k] - np.bitwise_count(other & ~mine).sum(axis=1, dtype=np.int64))
            for x in k[largest >= need[k]]:
                yield i, int(x)


def _compare_cells(percent: int, most: int | None):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        found = set()
        for _, group in cell.groupby(["bucket", "left", "right"], sort=False):
            left, right = group["left"].iloc[0], group["right"].iloc[0]
            a, b = group[group["block"] == left], group[group["block"] == right]
            ids_a, ids_b = a["node"].to_numpy(), b["node"].to_numpy()
            found.update((int(min(ids_a[i], ids_b[j])), int(max(ids_a[i], ids_b[j]))) for i, j in (*may_link(a, b, percent, most), *((i, j) for j, i in (may_link(b, a, percent, most) if most is not None and left != right else ()))))
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return run


def _sides(pairs: DataFrame, n: int, table: DataFrame, *columns: str) -> DataFrame:
    """The n pairs(a, b) with a_<c> and b_<c> of table(node, ...). pairs is staged and has each pair once, so the last join
    has no hot key; a leader's many pairs are in the first, where they are broadcast or can be split."""
    pairs = near(pairs, n)
    a, b = (table.join(pairs, table["node"] == pairs[end]).select("a", "b", *[F.col(c).alias(f"{end}_{c}") for c in columns]) for end in "ab")
    return a.join(b, ["a", "b"])


def _likely(percent: int, *columns: Column) -> Column:
    """Whether sizes, minima and bitmaps of both sides allow a link."""

    @F.pandas_udf("boolean")
    def run(na: pd.Series, nb: pd.Series, ma: pd.Series, mb: pd.Series, ba: pd.Series, bb: pd.Series) -> pd.Series:
        out, agree = [], agreement(percent)
        for x, y, mx, my, bx, by in zip(na, nb, ma, mb, ba, bb):
            need = int(least_common(x, y, percent))
            if need > min(x, y) or (np.frombuffer(mx, dtype="<u2") == np.frombuffer(my, dtype="<u2")).mean() < agree:
                out.append(False)
                continue
            p, q = np.frombuffer(bx, dtype=np.uint8), np.frombuffer(by, dtype=np.uint8)
            size = min(len(p), len(q))
            p, q = _fold(p, size), _fold(q, size)
            out.append(min(x - int(np.bitwise_count(p & ~q).sum()), y - int(np.bitwise_count(q & ~p).sum())) >= need)
        return pd.Series(out, dtype=bool)

    return run(*columns)


def _verified(pairs: DataFrame, n: int, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the n pairs (a, b) those whose whole sets are similar enough. texts(node, text)."""

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        kept: dict[str, np.ndarray] = {}

        def sets(texts: pd.Series) -> list[np.ndarray]:
            new = [t for t in texts.unique() if t not in kept]
            if len(kept) > 256:
                kept.clear()
                new = list(texts.unique())
            kept.update(zip(new, (shingles(words, width) for some in documents_words(new) for words in some)))
            return [kept[t] for t in texts]

        for left, right in batches:
            a = sets(left)
            out = []
            for x, y in zip(a, sets(right)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pd.Series(out, dtype=bool)

    return _sides(pairs, n, texts, "text").filter(linked("a_text", "b_text")).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, first) for each row of docs(doc_id, text, ...).

    Words are runs of characters other than space and the ASCII controls 9 to 13, A-Z lower-cased; a document's set
    holds its distinct shingles of `width` words, the whole sequence if it has fewer, and none without words. Documents
    are linked where 100 * intersection >= percent * union. component_id is the smallest doc_id that can be reached;
    kept marks it. text_key is the text's xxhash64; first marks the rows of a component's smallest (doc_id, text_key).

    What is left out, by odds: of links at 0.8, banding misses 4e-7 and the agreement of minima 6e-8; at 0.85, 1e-9 and
    6e-8; of higher ones less. Nothing else is left out.

    Null and empty texts have no shingles and are linked with nothing. Equal rows are linked and each is kept if its
    doc_id is the component's. Rows of one doc_id with different texts are told apart by their texts. Rows without
    doc_id take no part: component_id null, kept and first true. Other columns are not read; an empty table gives no
    rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = staged(rows.select("doc_id", "text_key", _signature(F.col("text"), width).alias("s")).select("doc_id", "text_key", "s.*"), "near-rows")
    some = signed.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    # Copies fold before the shuffle.
    nodes = some.groupBy("set_key").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key", "n_shingles", "minima", "bits")).alias("x"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("node"), "set_key", "copies", "x.*"), "near-nodes")
    slim = staged(signed.select("doc_id", "text_key", "n_shingles", "set_key"), "near-slim")
    discard(signed)

    bucket = F.explode(F.array(*[F.xxhash64(F.lit(b), F.substring("minima", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)]))
    members = nodes.select("node", "n_shingles", bucket.alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    # Bands that bring the same nodes together are one bucket.
    shared = staged(shared.filter("m > 1").groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "m"), "near-buckets")
    members = staged(members.join(shared, "bucket"), "near-members")
    signs = staged(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_key", "n_shingles", "minima", "bits"), "near-signs")
    ids = staged(nodes.select("set_key", "node", "doc_id", "text_key", "copies"), "near-ids")
    discard(nodes, shared)

    # The texts of the nodes that share a bucket: one copy of each, brought together once.
    n_met, n_members = signs.count(), members.count()
    wanted = signs.select("node", "doc_id", "text_key")
    texts = staged(rows.join(near(wanted, n_met), ["doc_id", "text_key"]).select("node", "text").dropDuplicates(["node"]), "near-texts")

    own = staged(members.withColumn("component", F.col("node")), "near-round", n_members)
    edges, components = None, None
    for search in (_leader_pairs, _best_pairs, _all_pairs):
        pairs = search(own, signs, percent, n_members)
        discard(own, components)
        edges = _more_edges(edges, pairs, texts, width, percent)
        n = edges.count()
        components = connected_components(edges, rows=n)
        own = _divided(members, components, n_members) if search is not _all_pairs else None
    discard(members, signs, texts)

    linked = staged(ids.join(near(components, 2 * n), "node"), "near-linked")
    least = staged(linked.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("x")), "near-least", n)
    alone = ids.join(near(components, 2 * n), "node", "left_anti").filter("copies > 1").select("set_key", F.struct("doc_id", "text_key").alias("x"))
    component_of = staged(linked.join(near(least, n), "component").select("set_key", "x").unionByName(alone), "near-result")
    discard(edges, linked, least, ids)
    out = slim.join(component_of, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("x.doc_id", "doc_id"))
    first = F.col("doc_id").isNull() | F.col("x").isNull() | ((F.col("doc_id") == F.col("x.doc_id")) & (F.col("text_key") == F.col("x.text_key")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key", F.coalesce(first, F.lit(True)).alias("first"))


def _divided(members: DataFrame, components: DataFrame, rows: int) -> DataFrame:
    """members with the components of the nodes, of buckets whose nodes are in more than one."""
    own = staged(members.join(near(components, rows), "node", "left").withColumn("component", F.coalesce("component", "node")), "near-placed", rows)
    buckets = own.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    out = staged(own.join(near(staged(buckets.select("bucket"), "near-divided", rows), rows), "bucket", "left_semi"), "near-round", rows)
    discard(own)
    return out


def _leader_pairs(own: DataFrame, signs: DataFrame, percent: int, rows: int) -> DataFrame:
    """Pairs of nodes with the leader of their bucket that signatures allow."""
    leaders = own.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node").alias("o"), "node", "n_shingles", "component")).alias("l"))
    leaders = staged(leaders.select("bucket", F.col("l.node").alias("leader"), F.col("l.n_shingles").alias("leader_n"), F.col("l.component").alias("leader_component")), "near-leaders", rows)
    alike = F.least("n_shingles", "leader_n") * 100 >= F.greatest("n_shingles", "leader_n") * percent
    pairs = own.join(near(leaders, rows), "bucket").filter((F.col("component") != F.col("leader_component")) & alike)
    pairs = staged(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "near-met", rows)
    discard(leaders)
    n = pairs.count()
    sides = _sides(pairs, n, signs, "n_shingles", "minima", "bits")
    out = staged(sides.filter(_likely(percent, *[F.col(f"{end}_{c}") for c in ("n_shingles", "minima", "bits") for end in "ab"])).select("a", "b"), "near-pairs")
    discard(pairs)
    return out


def _more_edges(edges: DataFrame | None, pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    n = pairs.count()
    found = staged(_verified(pairs, n, texts, width, percent), "near-found")
    out = found if edges is None else staged(found.unionByName(edges), "near-edges")
    discard(pairs, *((edges, found) if edges is not None else ()))
    return out


def _best_pairs(own: DataFrame, signs: DataFrame, percent: int, rows: int) -> DataFrame:
    return _pairs_in_blocks(own, signs, percent, BEST)


def _all_pairs(own: DataFrame, signs: DataFrame, percent: int, rows: int) -> DataFrame:
    return _pairs_in_blocks(own, signs, percent, None)


def _pairs_in_blocks(own: DataFrame, signs: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Candidate pairs of nodes that share a bucket and are in different components: in each block all, or the best of
    each node."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")
    own = own.withColumns({"blocks": blocks, "block": block})
    # A node goes to every pair of blocks that its own is in; a bucket within one block has one pair.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = own.withColumn("other", other).select("bucket", "node", "component", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    own = own.join(signs.select("node", "n_shingles", "minima", "bits"), "node")
    cells = max(1, math.ceil(own.count() / 4096))
    own = own.withColumn("cell", F.pmod(F.xxhash64("bucket", "left", "right"), F.lit(cells)))
    pairs = own.groupBy("cell").applyInPandas(_compare_cells(percent, most), "a long, b long")
    return staged(pairs.distinct(), "near-pairs")
