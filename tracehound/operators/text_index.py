"""Substring search over many rows by an index of trigrams: only blocks of rows that hold all trigrams of the text are read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.sources.staging import shared_folder

BLOCK, GRAM = 3, "__gram"
_BLOCK = "__block"
#: Characters whose pieces are sorted at once.
LOT = 1 << 20


def trigrams(text: Column) -> Column:
    """The different three-character pieces of a text in lower case; none of a shorter or null text.

    Three shifted copies of its characters side by side: linear in the text, where cutting pieces by place is not.
    """
    characters = F.split(F.lower(F.coalesce(text, F.lit(""))), "")
    size = F.greatest(F.size(characters) - (BLOCK - 1), F.lit(0))
    beside = F.arrays_zip(*[F.slice(characters, k + 1, size).alias(f"c{k}") for k in range(BLOCK)])
    return F.array_distinct(F.transform(beside, lambda z: F.concat(*[z[f"c{k}"] for k in range(BLOCK)])))


def _distinct(texts: list[str]) -> list[str]:
    """The different pieces of some texts, which are read side by side as numbers, LOT characters at a time."""
    at, found = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), []
    # A piece that reaches over a text's end is none.
    whole = np.ones(len(at) + BLOCK, dtype=bool)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    for k in range(1, BLOCK):
        whole[ends[ends >= k] - k] = False
    for low in range(0, len(at) - BLOCK + 1, LOT):
        some = at[low : low + LOT + BLOCK - 1].astype(np.int64)
        n = len(some) - BLOCK + 1
        found.append(np.unique((some[:n] << 42 | some[1 : n + 1] << 21 | some[2:])[whole[low : low + n]]))
    keys = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
    characters = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return [characters[i : i + BLOCK] for i in range(0, len(characters), BLOCK)]


def _block_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trigram, block) of rows(text, block): the different ones of some rows of a block at a time."""
    for batch in batches:
        rows = zip(batch.column(1).to_pylist(), batch.column(0))
        for block, own in groupby(rows, lambda row: row[0]):
            texts, size = [], 0
            for text in (row[1].as_py() for row in own):
                texts.append(text or "")
                size += len(texts[-1])
                if size >= LOT:
                    yield _of_block(texts, block)
                    texts, size = [], 0
            yield _of_block(texts, block)


def _of_block(texts: list[str], block: int) -> pa.RecordBatch:
    found = _distinct(texts)
    return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([block] * len(found), pa.int32())], names=[GRAM, _BLOCK])


def pieces_of(text: str) -> list[str]:
    low = text.lower()
    return sorted({low[i : i + BLOCK] for i in range(len(low) - BLOCK + 1)})


@dataclass(frozen=True)
class TextIndex:
    """Rows in blocks, each a folder, and which blocks hold a trigram. Both are tables at a folder that all of the cluster shares,
    and later sessions may open them."""

    spark: SparkSession
    path: str
    text: str

    @staticmethod
    def build(rows: DataFrame, text: Column, path: str | None = None, blocks: int = 256) -> TextIndex:
        """Rows are dealt to blocks by a hash of all of the text, so copies share a block. A trigram has at most `blocks`
        postings, whatever the number of rows."""
        import uuid

        path = path or f"{shared_folder(rows.sparkSession)}/text-index-{uuid.uuid4().hex}"
        placed = rows.withColumn("__text", F.lower(text)).withColumn(_BLOCK, F.pmod(F.xxhash64("__text"), F.lit(blocks)).cast("int"))
        placed.write.partitionBy(_BLOCK).parquet(f"{path}/rows")
        spark = rows.sparkSession
        grams = spark.read.parquet(f"{path}/rows").select("__text", _BLOCK).mapInArrow(_block_trigrams, f"{GRAM} string, {_BLOCK} int").distinct()
        # In order of the trigram, so that a search's filter skips all but a few row groups.
        grams.repartitionByRange(GRAM).sortWithinPartitions(GRAM).write.parquet(f"{path}/grams")
        return TextIndex(spark, path, "__text")

    def blocks_with(self, text: str) -> list[int] | None:
        """The blocks that hold every trigram of a text; None if it is too short to tell."""
        wanted = pieces_of(text)
        if not wanted:
            return None
        found = self.spark.read.parquet(f"{self.path}/grams").filter(F.col(GRAM).isin(*wanted)).groupBy(_BLOCK).agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))
        return sorted(r[0] for r in found.select(_BLOCK).collect())

    def search(self, text: str) -> DataFrame:
        """All rows whose text holds the text, in any case; a plain search over the blocks that may have some."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        blocks = self.blocks_with(text)
        if blocks is not None:
            rows = rows.filter(F.col(_BLOCK).isin(*blocks) if blocks else F.lit(False))
        return rows.filter(F.contains(self.text, F.lit(text.lower()))).drop("__text", _BLOCK)
