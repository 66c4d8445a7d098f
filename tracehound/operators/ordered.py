"""Detectors that depend on the order of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.sources.staging import staged

from .slices import followed, running, sliced


def failures_then_success(events: DataFrame, account: str, ts: str, tie: str, failed: Column, succeeded: Column, least: int = 5, slices: int | None = None) -> DataFrame:
    """(account, ts, tie, failures): successes that follow at least `least` failures in a row of the account.

    Every event that is not a failure ends the row. An account of any size is dealt to many tasks: the failures up to a
    success are those up to it less those up to the last event before it that was no failure, both running values.
    """
    marked = events.select(account, ts, tie, F.coalesce(failed, F.lit(False)).alias("__f"), F.coalesce(succeeded, F.lit(False)).alias("__s"))
    rows = sliced(marked, [account], [ts, tie], "streaks", slices)
    rows = running(rows, [account], [ts, tie], {"__failures": ("sum", F.col("__f").cast("long"))}, own=False)
    rows = running(rows, [account], [ts, tie], {"__ended": ("max", F.when(~F.col("__f"), F.col("__failures")))}, own=False)
    n = F.col("__failures") - F.coalesce("__ended", F.lit(0))
    return rows.withColumn("failures", n).filter(F.col("__s") & (F.col("failures") >= least)).select(account, ts, tie, "failures")


def off_hours(ts: Column, start: int = 22, end: int = 5) -> Column:
    return (F.hour(ts) >= start) | (F.hour(ts) < end)


def microseconds(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _with_reach(events: DataFrame, keys: list[str], us: str, tie: str, window_us: int, slices: int | None) -> DataFrame:
    """events, sliced, with __i, their place from 1 in their group, and __reach, the place of the last event up to window_us
    later. Each event stands there a second time, window_us later: what has passed by then is its reach."""
    kinds = F.explode(F.array(F.lit(0), F.lit(1))).alias("__kind")
    twice = events.select("*", kinds).withColumn("__when", F.col(us) + F.col("__kind") * F.lit(window_us))
    order = ["__when", "__kind", tie]
    rows = running(sliced(twice, keys, order, "bursts-events", slices), keys, order, {"__reach": ("sum", 1 - F.col("__kind").cast("long")), "__i": ("sum", F.col("__kind").cast("long"))})
    # The second places come in the order of the first, so the n-th is that of the n-th event.
    return rows.filter("__kind = 1").drop("__kind", "__when")


def in_bursts(events: DataFrame, keys: list[str], us: str, tie: str, window_us: int = 300_000_000, least: int = 3, slices: int | None = None) -> DataFrame:
    """The events that greedy bursts of their group of keys hold, with __start, the place of their burst's first event.

    From an event on, all events up to window_us after it are a burst if they are at least `least`; the next burst
    begins after it, else one event later. Events without a time belong to none. A group of any size is many tasks: an
    event's reach and the next event that could begin a burst are running values, and the bursts that do come about are
    found by following the starts from each event before which nothing happened for window_us.
    """
    rows = staged(_with_reach(events.filter(F.col(us).isNotNull()), keys, us, tie, window_us, slices), "bursts-reach")
    could = F.col("__reach") - F.col("__i") + 1 >= least
    rows = running(rows, keys, ["__i"], {"__coming": ("min", F.when(could, F.col("__i")))}, forward=False)
    # The event after one that reaches only itself begins anew; a burst that could begin first from there on does.
    rows = running(rows, keys, ["__i"], {"__anew": ("max", F.when(F.col("__reach") == F.col("__i"), F.col("__i") + 1)), "__former": ("max", F.when(could, F.col("__i")))}, own=False)
    rows = staged(rows, "bursts-places")
    starts = rows.filter(could).withColumn("__on", F.coalesce("__former", F.lit(0)) < F.coalesce("__anew", F.lit(1)))
    coming = rows.select(*[F.col(k).alias(f"__c_{k}") for k in keys], (F.col("__i") - 1).alias("__behind"), F.col("__coming").alias("__next"))
    same = [F.col(k).eqNullSafe(F.col(f"__c_{k}")) for k in keys]
    starts = starts.join(coming, [*same, F.col("__reach") == F.col("__behind")], "left").select(*keys, "__i", "__next", "__on")
    begun = followed(starts, keys).select(*[F.col(k).alias(f"__c_{k}") for k in keys], F.col("__i").alias("__b"))
    rows = rows.join(begun, [*same, F.col("__i") == F.col("__b")], "left")
    # The last burst begun, and where it ends.
    rows = running(rows, keys, ["__i"], {"__start": ("max", F.col("__b")), "__end": ("max", F.when(F.col("__b").isNotNull(), F.col("__reach")))})
    return rows.filter("__i <= __end").select(*events.columns, "__start")


def bursts(events: DataFrame, keys: list[str], ts: str, tie: str, window_us: int = 300_000_000, least: int = 3, slices: int | None = None) -> DataFrame:
    """Greedy bursts, see in_bursts, for each group of keys: (keys, burst_start, burst_end, n)."""
    held = in_bursts(events.select(*keys, tie, microseconds(F.col(ts)).alias("__us")), keys, "__us", tie, window_us, least, slices)
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return held.groupBy(*keys, "__start").agg(time(F.min("__us")).alias("burst_start"), time(F.max("__us")).alias("burst_end"), F.count("*").alias("n")).drop("__start")


def neighbourhood(events: DataFrame, ts: str, tie: str, match: Column, around: int = 5) -> DataFrame:
    """The events within `around` places of the first match in time order.

    The match is found by a minimum; the neighbours on each side by two top-k, so nothing is sorted as a whole.
    """
    first = events.filter(match).select(F.struct(ts, tie).alias("p")).agg(F.min("p").alias("p"))
    placed = events.join(F.broadcast(first), F.lit(True)).withColumn("__p", F.struct(ts, tie))
    before = placed.filter(F.col("__p") < F.col("p")).orderBy(F.desc(ts), F.desc(tie)).limit(around)
    after = placed.filter(F.col("__p") >= F.col("p")).orderBy(ts, tie).limit(around + 1)
    return before.unionByName(after).drop("p", "__p")


def first_of_each(rows: DataFrame, keys: list[str], order: list, n: int | None) -> DataFrame:
    """The first n rows of each group, all if n is None; each task keeps n rows of a group before the shuffle."""
    if n is None:
        return rows
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
