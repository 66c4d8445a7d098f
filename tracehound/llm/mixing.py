"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged, text_or_empty

WEIGHTS = (5, 2, 1)
#: Sources up to this many are sent to every task; beyond it the join shuffles.
BROADCAST_SOURCES = 50_000
#: Words in a shard of a source, in which the blocks are chosen.
SHARD_WORDS = 500_000
#: Rows of a shard, whatever words they have.
SHARD_ROWS = 20_000
#: Sources, or shards of a source, among which seats are dealt in one task; more are dealt to in groups of so many first.
DEALT_TOGETHER = 4096
#: Equal rows that are placed together; more are cut into lots that are placed each by itself.
LOT = 1000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and the ASCII controls 9 to 13."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def highest_quotients(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Laguë: seats go one by one to the highest weight / (2 * own seats + 1), up to `most` seats each.

    Only the end of that sequence is played: rounding each exact share down and taking one off gives seats that all
    are dealt before any of the last ones, which the heap then deals.
    """
    weights, most = np.asarray(weights, dtype=float), np.asarray(most, dtype=np.int64)
    seats = int(min(seats, most[weights > 0].sum())) if len(weights) else 0
    got = np.zeros(len(weights), dtype=np.int64)
    open_ = weights > 0
    while open_.any() and seats > got[~open_].sum():
        share = weights * ((seats - got[~open_].sum()) / weights[open_].sum())
        full = open_ & (share >= most)
        if not full.any():
            got[open_] = np.maximum(0, np.floor(share[open_] - 0.5).astype(np.int64) - 1)
            break
        got[full] = most[full]
        open_ &= ~full
    over = int(got.sum()) - seats
    back = [(weights[i] / (2 * got[i] - 1), i) for i in np.flatnonzero(got > 0)] if over > 0 else []
    heapq.heapify(back)
    for _ in range(max(0, over)):
        _, i = heapq.heappop(back)
        got[i] -= 1
        if got[i] > 0:
            heapq.heappush(back, (weights[i] / (2 * got[i] - 1), i))
    heap = [(-weights[i] / (2 * got[i] + 1), int(i)) for i in np.flatnonzero((got < most) & (weights > 0))]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def deal_seats(items: DataFrame, owner: str, order: str) -> DataFrame:
    """items(owner, order, weight, most, seats, ...) + own_seats: the owner's seats by highest quotients of weight.

    Items are dealt to in groups of DEALT_TOGETHER by their order (0, 1, ...): first the owner's seats to its groups, then
    a group's to its items, so that no task holds more than that many items or groups.
    """
    items = staged(items.withColumn("group", F.floor(F.col(order) / DEALT_TOGETHER)), "mix-items")

    def run(key: str, out: str):
        def deal(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(key, kind="stable")
            got = highest_quotients(group["weight"].to_numpy(), int(group["seats"].iloc[0]), group["most"].to_numpy(dtype=np.int64)) if len(group) else []
            return group.assign(**{out: got})[["owner", "group", *([key] if key != "group" else []), out]]

        return deal

    items = items.withColumn("owner", F.col(owner))
    groups = items.groupBy("owner", "group", "seats").agg(F.sum(F.floor("weight")).cast("double").alias("weight"), F.sum("most").alias("most"))
    kind = dict(items.dtypes)["owner"]
    groups = staged(groups.groupBy("owner").applyInPandas(run("group", "group_seats"), f"owner {kind}, group long, group_seats long").withColumnsRenamed({"owner": "__owner", "group": "__group"}), "mix-groups")
    within = items.join(groups, F.col("owner").eqNullSafe(F.col("__owner")) & (F.col("group") == F.col("__group"))).withColumn("seats", F.col("group_seats")).select("owner", "group", F.col(order).alias("order"), "weight", "most", "seats")
    dealt = within.groupBy("owner", "group").applyInPandas(run("order", "own_seats"), f"owner {kind}, group long, order long, own_seats long").withColumnsRenamed({"owner": "__owner", "order": "__order"}).drop("group")
    return items.join(dealt, F.col("owner").eqNullSafe(F.col("__owner")) & (F.col(order) == F.col("__order"))).drop("__owner", "__order", "owner", "group")


def ranked(sources: DataFrame) -> DataFrame:
    """sources(source, ...) + rank: 0, 1, ... by code point, null last; one row a source. Ranges of the order are numbered
    apart from one another; only their lengths meet in one task."""
    order = [F.col("source").isNull(), F.col("source")]
    n = sources.count()
    ranged = staged(sources.repartitionByRange(max(1, -(-n // 100_000)), *order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = ranged.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1)
    return own.join(starts, "range").withColumn("rank", (F.col("start") + F.col("at")).cast("long")).drop("range", "start", "at")


def with_targets(sources: DataFrame, weights: tuple[int, ...], share: float, stop: int) -> DataFrame:
    """sources(source_size, rank) + target: share * all words by weight; what is above stop * source_size goes to the others.

    A target is the lesser of stop * source_size and weight * level. The level rises until no more targets stop; only
    whole sums of sizes and weights decide it.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    sources = staged(sources.withColumn("weight", weight), "mix-ranked")
    total, open_ = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, stopped = share * total, 0
    while open_:
        full = F.col("weight") * left / open_ >= F.col("source_size") * stop
        n, size, still = sources.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == stopped:
            break
        stopped, left, open_ = n, share * total - stop * size, still
    level = F.col("weight") * left / open_ if open_ else F.lit(float("inf"))
    return sources.withColumn("target", F.least(level, (F.col("source_size") * stop).cast("double"))).drop("weight")


def _plan_sources(sources: DataFrame, weights: tuple[int, ...], share: float, stop: int, block_words: int) -> DataFrame:
    """sources(source, source_size, rows) -> (source, source_size, rows, target, block, blocks)."""
    sources = staged(with_targets(ranked(sources), weights, share, stop), "mix-targets")
    total, small = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.min(F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(1))).first()
    block = min(max(small // 1000, 1), 64) if block_words < 1 else block_words
    most = F.floor(F.col("source_size") * stop / block) + (F.col("source_size") > 0).cast("int")
    items = sources.withColumns({"all": F.lit(0), "weight": F.col("target"), "most": most.cast("long"), "seats": F.lit(round(min(share, stop) * total / block)).cast("long")})
    return deal_seats(items, "all", "rank").select("source", "source_size", "rows", "target", F.lit(block).cast("long").alias("block"), F.col("own_seats").alias("blocks"))


def _plan_shards(shards: DataFrame, stop: int, seed: int) -> DataFrame:
    """shards(source, shard, block, blocks, words) -> (source, shard, own, quota, step, shift)."""
    own = F.ceil(F.col("words") / F.col("block"))
    items = shards.withColumns({"own": own, "weight": F.col("words").cast("double"), "most": own * stop, "seats": F.col("blocks")})

    @F.pandas_udf("step long, shift long")
    def permutation(source: pd.Series, shard: pd.Series, own: pd.Series) -> pd.DataFrame:
        """Multiples of a number prime to n visit all of 0 to n - 1 once; the seed chooses the number and the start."""
        rows = []
        for name, k, n in zip(source, shard, own):
            drawn = [zlib.crc32(f"{seed}:{name}:{k}:{what}".encode("utf-8", "surrogatepass")) for what in ("step", "shift")]
            step = 1 + drawn[0] % max(n, 1)
            while math.gcd(step, max(n, 1)) > 1:
                step += 1
            rows.append((step, drawn[1]))
        return pd.DataFrame(rows, columns=["step", "shift"])

    dealt = deal_seats(items, "source", "shard").withColumn("p", permutation("source", "shard", "own"))
    return dealt.select("source", "shard", "own", F.col("own_seats").alias("quota"), "p.step", "p.shift")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, stop: int = 2, seed: int = 17, block_words: int = 0, whole: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, + keep) for each row of docs(doc_id, text, source, ...).

    The sources, by code point with null last, weigh `weights` in turn and share `share` of all words; no target is
    above `stop` times its source's words, and the excess goes to the others by weight. Blocks of block_words words
    (0: a thousandth of the smallest source, 1 to 64) are dealt to the sources by highest quotients, each source's
    blocks to its shards likewise, and a seeded permutation of a shard's blocks says which are taken (a quota beyond
    all blocks takes all of them and some again): block j is taken if (j * step + shift) modulo their number is low
    enough, step being prime to that number. taken counts a document's words in the taken blocks, with repeats:
    at most `stop` times its size. With whole, a document goes with the block in which it begins.

    Null texts have size 0 and take nothing, null sources are one source, repeated rows are mixed each by itself; an
    empty table gives no rows. Reruns agree: shard, order and choice depend on doc_id, text key and seed only.
    """
    same = F.xxhash64("doc_id", text_or_empty(), F.lit(seed))
    rows = docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), same.alias("tie"), *keep)
    # Equal rows are one from here on, in lots, so that a row that a third of the table repeats is placed like any other.
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    lots = rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / LOT))))
    rows = staged(lots.withColumn("copies", F.least(F.lit(LOT), F.col("copies") - F.col("lot") * LOT)), "mix-rows")
    # One row for each source from here: a table of sources, not of documents.
    sources = staged(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("rows")), "mix-sizes")
    plan = _plan_sources(sources, weights, share, stop, block_words)
    plan = staged(plan.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("rows") / SHARD_ROWS), F.lit(1))).drop("rows"), "mix-sources")
    small = plan.count() <= BROADCAST_SOURCES
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)

    def with_sources(df: DataFrame, side: DataFrame, *on: str) -> DataFrame:
        side = side.withColumnRenamed("source", "own_source")
        cond = F.col("source").eqNullSafe(F.col("own_source"))
        for c in on:
            side = side.withColumnRenamed(c, f"own_{c}")
            cond = cond & (F.col(c) == F.col(f"own_{c}"))
        return df.join(near(side), cond).drop("own_source", *(f"own_{c}" for c in on))

    sharded = with_sources(rows, plan).withColumn("shard", F.pmod(F.xxhash64("tie", "lot"), F.col("shards")))
    in_shard = Window.partitionBy("source", "shard").orderBy("doc_id", "tie", "lot", *keep)
    words = F.col("size") * F.col("copies")
    placed = staged(sharded.withColumn("start", F.sum(words).over(in_shard) - words), "mix-placed")
    quotas = placed.groupBy("source", "shard", "block", "blocks").agg(F.sum(words).alias("words"))
    quotas = staged(_plan_shards(quotas, stop, seed), "mix-quotas")
    small = quotas.count() <= BROADCAST_SOURCES
    # Each copy of a lot has its own words.
    chosen = with_sources(placed, quotas, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    chosen = chosen.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    chosen = chosen.withColumns({"n": F.greatest("own", F.lit(1)), "rest": F.when(F.col("own") > 0, F.col("quota") % F.col("own")).otherwise(0)})
    base = F.when(F.col("own") > 0, F.floor(F.col("quota") / F.col("n"))).otherwise(0)
    if whole:
        takes = "cast(((start div block) * step + shift) % n < rest as bigint)"
        taken = F.col("size") * (base + F.expr(takes))
    else:
        part = """case when size = 0 or rest = 0 then 0L else aggregate(sequence(start div block, (start + size - 1) div block), 0L,
            (a, j) -> a + if((j * step + shift) % n < rest, least((j + 1) * block, start + size) - greatest(j * block, start), 0L)) end"""
        taken = F.col("size") * base + F.expr(part)
    return chosen.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)
