"""Process ancestry: parents, chains of ancestors, and suspicious lineages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.functions.scalars import any_of
from tracehound.functions.tables import LINEAGES, TOOL_NAMES

MOST_NODES = 13


def last_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Where a key is used again, its last row."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("__r")).select(*keys, "__r.*")


def with_parent(processes: DataFrame, scope: list[str], pid: str = "pid", ppid: str = "ppid", name: str = "name", order: str = "row_index") -> DataFrame:
    """processes with parent_name, by (scope, pid)."""
    parents = last_rows(processes.select(*scope, pid, name, order), [*scope, pid], order).select(*[F.col(s).alias(f"__{s}") for s in scope], F.col(pid).alias("__pid"), F.col(name).alias("parent_name"))
    return processes.join(parents, [*[F.col(s).eqNullSafe(F.col(f"__{s}")) for s in scope], F.col(ppid) == F.col("__pid")], "left").drop("__pid", *[f"__{s}" for s in scope])


def ancestry(processes: DataFrame, scope: list[str], pid: str = "pid", ppid: str = "ppid", name: str = "name", order: str = "row_index", nodes: int = MOST_NODES) -> DataFrame:
    """(scope, leaf, pids, names, depth): the chain of each process from its farthest ancestor to itself.

    At most `nodes` long, and it ends before a process would stand in it twice. Chains double in length with each
    round of joins, so the rounds are the logarithm of the depth.
    """
    own = last_rows(processes.select(*scope, pid, ppid, name, order), [*scope, pid], order)
    # up: the chain from the process upwards, and the next process to follow.
    chain = own.select(*scope, F.col(pid).alias("leaf"), F.array(pid).alias("up"), F.array(name).alias("up_names"), F.when(F.col(ppid) != F.col(pid), F.col(ppid)).alias("next"))
    length = 1
    while length < nodes:
        more = chain.select(*[F.col(s).alias(f"__{s}") for s in scope], F.col("leaf").alias("__leaf"), F.col("up").alias("__up"), F.col("up_names").alias("__names"), F.col("next").alias("__next"))
        joined = chain.join(more, [*[F.col(s).eqNullSafe(F.col(f"__{s}")) for s in scope], F.col("next") == F.col("__leaf")], "left")
        both, names = F.concat("up", F.coalesce("__up", F.array().cast("array<string>").cast(processes.select(F.array(pid).alias("x")).schema["x"].dataType))), F.concat("up_names", F.coalesce("__names", F.array().cast("array<string>")))
        # Cut where a process comes a second time, or the chain is long enough.
        places = F.filter(F.sequence(F.lit(1), F.size(both)), lambda i: F.array_position(both, F.element_at(both, i)) < i)
        keep = F.least(F.coalesce(F.array_min(places) - 1, F.size(both)), F.lit(nodes))
        done = (keep < F.size(both)) | (keep >= nodes)
        chain = joined.select(*scope, "leaf", F.slice(both, 1, keep).alias("up"), F.slice(names, 1, keep).alias("up_names"), F.when(~done, F.col("__next")).alias("next"))
        length *= 2
    return chain.select(*scope, "leaf", F.reverse("up").alias("pids"), F.reverse("up_names").alias("names"), F.size("up").alias("depth"))


def lineage_label(names: Column) -> Column:
    """`ancestor > descendant` of the first lineage rule that the chain shows, else a known tool's name, else null."""
    lower = F.transform(names, F.lower)
    found = []
    for ancestors, descendants in LINEAGES:
        ups, downs = [a.lower() for a in ancestors], [d.lower() for d in descendants]
        at = F.filter(F.sequence(F.lit(1), F.size(lower)), lambda i: F.element_at(lower, i).isin(*ups) & F.exists(F.slice(lower, i + 1, F.size(lower)), lambda d: d.isin(*downs)))
        i = F.try_element_at(at, F.lit(1))
        down = F.try_element_at(F.filter(F.slice(lower, i + 1, F.size(lower)), lambda d: d.isin(*downs)), F.lit(1))
        found.append(F.when(i.isNotNull(), F.concat_ws(" > ", F.element_at(lower, i), down)))
    tool = F.try_element_at(F.filter(lower, lambda n: any_of([n.contains(t) for t in TOOL_NAMES])), F.lit(1))
    return F.coalesce(*found, tool)


def process_trees(chains: DataFrame, most: int | None = None) -> DataFrame:
    """Chains of three processes or more, or suspicious ones: suspicious first, then the deepest."""
    trees = chains.filter(F.col("depth") >= 2).withColumn("label", lineage_label(F.col("names")))
    trees = trees.select("*", F.array_join("names", " > ").alias("chain"), F.col("label").isNotNull().alias("suspicious")).filter((F.col("depth") >= 3) | F.col("suspicious"))
    return trees if most is None else trees.orderBy(F.desc("suspicious"), F.desc("depth"), "leaf").limit(most)


def place_in_order(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
