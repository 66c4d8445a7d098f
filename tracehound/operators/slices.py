"""Running sums, minima and maxima in the order of a key's rows, for keys of any size.

Rows are dealt in ranges of (key, order), so a key with many rows is many slices and no task has more than its share. What the
rows before a slice come to is one value for each slice, folded over the slices of a key; within a slice a window goes on
from there. A slice has at most one key that began in an earlier one, so what is folded and sent to all tasks has no more
rows than there are slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.sources.staging import discard, near, staged

SLICE = "__slice"
#: How a running value is made of two, and a window's function for it.
_TWO = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
_OF = {"sum": F.sum, "max": F.max, "min": F.min}


def sliced(rows: DataFrame, keys: list[str], order: list[str], label: str, slices: int | None = None) -> DataFrame:
    """rows, staged, with the number of the range of (keys, order) that each is in; equal rows share one."""
    n = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.repartitionByRange(n, *keys, *order).withColumn(SLICE, F.spark_partition_id()), label)


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], forward: bool = True, own: bool = True, sent: bool = True) -> DataFrame:
    """rows(…, __slice) with a running value for each of values(name: (sum, max or min, column)): over the rows of the same
    keys up to the row itself, or before it if not own; from the row to the last if not forward. Slices need not be
    made by sliced(): with sent=False what is folded is joined by key, for slices of which there may be very many."""
    # Backwards is the reverse order: a frame up to the last row is folded anew for each row, one from the first goes on.
    directed = lambda names: [F.col(n).asc() if forward else F.col(n).desc() for n in names]
    before = Window.unboundedPreceding
    local = Window.partitionBy(*keys, SLICE).orderBy(*directed(order)).rowsBetween(before, 0 if own else -1)
    past = Window.partitionBy(*keys).orderBy(*directed([SLICE])).rowsBetween(before, -1)
    made = rows.withColumns({f"__v_{name}": value for name, (_, value) in values.items()})
    totals = made.groupBy(*keys, SLICE).agg(*[_OF[how](f"__v_{name}").alias(f"__t_{name}") for name, (how, _) in values.items()])
    carried = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(SLICE).alias("__at"), *[_OF[how](f"__t_{name}").over(past).alias(f"__c_{name}") for name, (how, _) in values.items()], F.count("*").over(past).alias("__n"))
    carried = carried.filter("__n > 0").drop("__n")
    same = F.col(SLICE) == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = made.withColumns({f"__l_{name}": _OF[how](f"__v_{name}").over(local) for name, (how, _) in values.items()})
    out = out.join(F.broadcast(carried) if sent else carried, same, "left")
    return out.select(*rows.columns, *[_TWO[how](F.col(f"__l_{name}"), F.col(f"__c_{name}")).alias(name) for name, (how, _) in values.items()])


def numbered(rows: DataFrame, order: list[str], name: str, label: str, slices: int | None = None) -> DataFrame:
    """rows with their place from 1 in an order over all rows, which no task holds: each range of the order counts on from
    those before it."""
    return running(sliced(rows, [], order, label, slices), [], order, {name: ("sum", F.lit(1).cast("long"))}).drop(SLICE)


def packed(rows: DataFrame, order: list[str], size: str, most: int, name: str, label: str, slices: int | None = None) -> DataFrame:
    """rows with the number from 0 of their pack: in order, each goes to the pack of the one before unless the pack's sizes would
    come to more than `most`. No size is above it, nor under 1.

    What a pack that begins with a row would hold is a running value; which rows do begin one is found by following these
    from the first row, in rounds that follow the logarithm of the packs.
    """
    rows = running(sliced(rows, [], order, label, slices), [], order, {"__end": ("sum", F.col(size)), "__i": ("sum", F.lit(1).cast("long"))})
    rows = staged(rows.drop(SLICE), f"{label}-ends")
    # Each row stands twice: where its size ends, and where a pack that begins with it would be full.
    marks = F.explode(F.array(F.struct(F.col("__end").alias("at"), F.lit(0).alias("kind")), F.struct((F.col("__end") - F.col(size) + most).alias("at"), F.lit(1).alias("kind")))).alias("m")
    passed = sliced(rows.select("__i", marks).select("__i", "m.*"), [], ["at", "kind", "__i"], f"{label}-marks", slices)
    reach = running(passed, [], ["at", "kind", "__i"], {"__reach": ("sum", 1 - F.col("kind").cast("long"))}).filter("kind = 1")
    begun = followed(reach.select("__i", (F.col("__reach") + 1).alias("__next"), (F.col("__i") == 1).alias("__on")), [])
    first = begun.select(F.col("__i").alias("__b"))
    marked = rows.join(first, F.col("__i") == F.col("__b"), "left").drop("__end")
    out = running(sliced(marked, [], ["__i"], f"{label}-packs", slices), [], ["__i"], {name: ("sum", F.col("__b").isNotNull().cast("long"))})
    return out.withColumn(name, F.col(name) - 1).drop(SLICE, "__i", "__b")


def followed(starts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of starts(keys, __i, __next, __on) that are on, or that rows on lead to by any number of steps of __next.

    Pointers are doubled twice a round, and what a row on points to becomes on, so the rounds follow the logarithm of the
    longest chain.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    starts = staged(starts.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "__i", "__next", "__on"), "chain-starts")
    size = starts.count()

    def doubled(rows: DataFrame) -> DataFrame:
        onward = near(rows.select(*[F.col(n).alias(f"{n}_o") for n in names], F.col("__i").alias("__at"), F.col("__next").alias("__further")), size)
        reached = near(rows.filter("__on and __next is not null").select(*[F.col(n).alias(f"{n}_r") for n in names], F.col("__next").alias("__to")).distinct(), size)
        same = lambda suffix: [F.col(n).eqNullSafe(F.col(f"{n}{suffix}")) for n in names]
        rows = rows.join(reached, [*same("_r"), F.col("__i") == F.col("__to")], "left").withColumn("__on", F.col("__on") | F.col("__to").isNotNull())
        rows = rows.join(onward, [*same("_o"), F.col("__next") == F.col("__at")], "left")
        return rows.select(*names, "__i", F.col("__further").alias("__next"), "__on")

    while True:
        after = staged(doubled(doubled(starts)), "chain-starts")
        discard(starts)
        starts = after
        if starts.filter("__next is not null").isEmpty():
            return starts.filter("__on").select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "__i")
