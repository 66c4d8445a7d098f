"""Assignment of documents to shards of near-equal bytes by Karmarkar-Karp differencing.

Equal texts form one indivisible group. The differencing runs in blocks of a bounded number of groups, one block a
task: each block is cut into as many lumps as there are shards, the lumps are the items of the next level, and the
last level, which is one block, makes the shards. Groups so large that a shard holds only a few dozen of them skip
the lower levels, so that the last level can put the lumps around them.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged, text_key, text_or_empty

BLOCK_ITEMS = 4096
#: Copies of one row that are placed together.
LOT = 1000
#: Items above total / (shards * COARSE) go straight to the last level; at most shards * COARSE of them exist, and
#: less for small blocks, so that each level has fewer items than the one before.
COARSE = 32


def difference(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The way (0 to ways - 1) of each item, by Karmarkar-Karp differencing.

    A partial partition is a list of (sum, parts) pairs in falling order of sum, parts being nested item lists. The two
    with the largest spread are combined, the largest sum of one with the smallest of the other, until one is left.
    Way 0 has the largest sum.
    """
    if not len(sizes):
        return np.zeros(0, dtype=np.int32)
    heap = [(-int(s), i, [(int(s), i)] + [(0, None)] * (ways - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = [(x + y, (p, q) if p is not None and q is not None else p if q is None else q) for (x, p), (y, q) in zip(a, reversed(b))]
        both.sort(key=lambda pair: -pair[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], serial, both))
        serial += 1
    ways_of = np.zeros(len(sizes), dtype=np.int32)
    for way, (_, parts) in enumerate(heap[0][2]):
        stack = [parts]
        while stack:
            part = stack.pop()
            if isinstance(part, tuple):
                stack.extend(part)
            elif part is not None:
                ways_of[part] = way
    return ways_of


def _difference_blocks(ways: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["bytes", "id"], ascending=[False, True], kind="stable")
        return pd.DataFrame({"id": block["id"], "block": block["block"], "way": difference(block["bytes"].to_numpy(), ways), "bytes": block["bytes"]})

    return run


def group_shards(groups: DataFrame, shards: int, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """groups(id binary, bytes long), ids distinct -> (id, shard)."""
    schema = "id binary, block long, way int, bytes long"
    levels, items = [], groups
    few = shards * max(1, min(COARSE, block_items // (4 * shards)))
    while True:
        n, total = items.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        if n <= block_items:
            break
        coarse = F.col("bytes") > total / few
        blocks = max(1, math.ceil(n / block_items))
        fine = items.filter(~coarse).withColumn("block", F.pmod(F.xxhash64("id", F.lit(len(levels))), F.lit(blocks)))
        placed = staged(fine.groupBy("block").applyInPandas(_difference_blocks(shards), schema), "shard-level")
        lump = F.encode(F.concat_ws(":", F.lit(f"lump{len(levels)}"), "block", "way"), "UTF-8")
        levels.append(placed.select("id", lump.alias("lump")))
        items = staged(items.filter(coarse).select("id", "bytes").unionByName(placed.groupBy(lump.alias("id")).agg(F.sum("bytes").alias("bytes"))), "shard-items")
    last = items.withColumn("block", F.lit(0).cast("long")).groupBy("block").applyInPandas(_difference_blocks(shards), schema)
    shard_of = staged(last.select("id", F.col("way").alias("shard")), "shard-top")
    for level in reversed(levels):
        below = level.join(shard_of.withColumnRenamed("id", "lump"), "lump").select("id", "shard")
        shard_of = below.unionByName(shard_of)
    return shard_of


def shard_documents(docs: DataFrame, shards: int = 8, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs(doc_id, text, ...).

    Law `bytes`: the shards' sums of size are nearly equal, as far as the groups of equal texts, which stay together,
    allow. size is the text's UTF-8 bytes plus 1. Null texts count as empty, so null and empty texts are one group.
    Rows with null or repeated doc_id keep their own slots. Slots run from 0 without gaps in each shard. An empty table
    gives no rows; other columns of docs are not read.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), text_key(text).alias("id"))
    # Equal rows are one from here on, in lots, so that a row that a third of the table repeats is no cell of its own.
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    lots = rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / LOT))))
    rows = staged(lots.withColumn("copies", F.least(F.lit(LOT), F.col("copies") - F.col("lot") * LOT)), "shard-rows")
    groups = staged(rows.groupBy("id").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")), "shard-groups")
    # Cells of some thousand rows, so that no shard is one task; their number is bounded.
    cells = min(20_000, max(1, math.ceil(rows.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] / 2048)))
    placed = rows.join(group_shards(groups, shards, block_items), "id")
    placed = staged(placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "id", "lot", F.lit(7)), F.lit(cells)).cast("int")), "shard-placed")
    in_cell = Window.partitionBy("shard", "cell").orderBy("doc_id", "id", "lot")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards * cells rows.
    starts = placed.groupBy("shard", "cell").agg(F.sum("copies").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (
        placed.withColumn("at", F.sum("copies").over(in_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies"))
        .join(F.broadcast(starts), ["shard", "cell"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at") + F.col("copy")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
