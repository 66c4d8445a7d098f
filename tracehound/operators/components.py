"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.sources.staging import discard, near, staged



def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def _least(pairs: DataFrame, n: int) -> DataFrame:
    """The least neighbour of each of at most n nodes u of pairs(u, v), as a table: where it is joined by a shuffle, the
    pairs of a hub can then be split."""
    return staged(pairs.groupBy("u").agg(F.min("v").alias("least")), "star-least", n)


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, component) for each node of edges(a, b), ids of any one type; component is the least node that can be reached.

    Large-star ties every larger neighbour of a node to the node's least neighbour, small-star the node itself and its
    smaller neighbours. Neither adds edges; when nothing changes every edge leads to its component. Nulls and loops
    are left out; repeated edges count once. No edges give no rows. rows: how many edges there are at most, where
    that is known. With too few rounds the component is the least node found so far. Tables are deleted once used.
    """
    edges = staged(_ordered(edges), "star-edges", rows)
    before = _state(edges)
    n = before[0]
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = _least(both, 2 * n)
        large = both.join(near(least, 2 * n), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.least("least", "u").alias("b"))
        large = staged(large.filter("a != b").distinct(), "star-large", n)
        discard(least, edges)
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = _least(down, n)
        small = down.join(near(least, n), "u").filter(F.col("v") != F.col("least")).select(F.col("v").alias("a"), F.col("least").alias("b"))
        edges = staged(_ordered(small.unionByName(least.select(F.col("u").alias("a"), F.col("least").alias("b")))), "star-edges", n)
        discard(least, large)
        now = _state(edges)
        if now == before:
            break
        before = now
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return staged(found.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component")), "star-components", 2 * n)
