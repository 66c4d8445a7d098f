"""Approximate nearest neighbours by largest inner product: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node. Each node starts with the best of three cells of nodes, two of similar directions and a
random one; then, round by round, the neighbours of a node (those it names and some of those that name it) are brought
together by joins, and every two of them, one at least being new, are proposed to each other, until a round changes
hardly an edge. The search keeps a beam of nodes for each query and expands
the best unexpanded ones by joins with the graph. Graph and search use vectors of 8-bit components, each with a scale of
its own, so that a long vector takes nothing from the others. For the graph they are lengthened by one component, kept
apart, to equal norm, so that inner product and distance agree; scores are computed from the original vectors.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType

from .shared import discard, near, staged

DEGREE = 24
REVERSE = 16
#: Share of new edges at which the rounds end.
SETTLED = 0.03
#: Proposals that a node gets in one place of meeting.
PROPOSALS = 8
CELL = 512
#: Queries and rows that are compared at a time where the search is exact.
EXACT_QUERIES, EXACT_ROWS = 2048, 8192
#: Longest nodes, at which each search begins besides its own node: they are near all queries, but few edges lead to them.
ENTRIES = 64


def _vectors(rows: pd.Series) -> np.ndarray:
    """Vectors of rows, the added component being the last."""
    data = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
    scale, rest = np.ascontiguousarray(data[:, :16]).view(np.float64).T
    return np.hstack([data[:, 16:].view(np.int8) * scale[:, None], rest[:, None]])


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all pairs less the common square of the norm: minus half the squared distance. The added
    components may be far larger than what tells vectors apart, so their difference is taken first."""
    x, y = a[:, :-1], b[:, :-1]
    return x @ y.T - 0.5 * ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) + (a[:, -1:] - b[:, -1]) ** 2)


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v array<double>): rows with an id and a finite, non-zero vector of the most frequent length."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    good = good.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    return good.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))


def _quantised(nodes: DataFrame) -> DataFrame:
    """(node, q): the vector's scale, the component that brings all vectors to the largest norm, and signed bytes."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    norm2 = float(nodes.agg(F.max(square)).first()[0] or 1.0)

    @F.pandas_udf("binary")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vs in batches:
            m = np.array(vs.tolist(), dtype=np.float64) if len(vs) else np.empty((0, 1))
            rest = np.sqrt(np.maximum(norm2 - (m * m).sum(axis=1), 0.0))
            scale = np.abs(m).max(axis=1) / 127.0
            signed = np.clip(np.rint(m / scale[:, None]), -127, 127).astype(np.int8)
            yield pd.Series([h.tobytes() + r.tobytes() for h, r in zip(np.stack([scale, rest], axis=1), signed)], dtype=object)

    return nodes.select("node", pack("v").alias("q"))


def _best(u: np.ndarray, c: np.ndarray, s: np.ndarray, fresh: np.ndarray, degree: int) -> tuple[np.ndarray, ...]:
    """Of candidates c with similarity s for nodes u: the best `degree` distinct ones of each node. Ties: smaller id.
    A candidate that was there before is not fresh."""
    order = np.lexsort((fresh, c, u))
    u, c, s, fresh = u[order], c[order], s[order], fresh[order]
    first = np.concatenate([[True], (u[1:] != u[:-1]) | (c[1:] != c[:-1])]) & (u != c)
    u, c, s, fresh = u[first], c[first], s[first], fresh[first]
    order = np.lexsort((c, -s, u))
    u, c, s, fresh = u[order], c[order], s[order], fresh[order]
    rank = np.arange(len(u)) - np.searchsorted(u, u)
    top = rank < degree
    return u[top], c[top], s[top], fresh[top]


def _start(degree: int):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        ids, m = cell["node"].to_numpy(), _vectors(cell["q"])
        out = []
        for low in range(0, len(ids), 1024):
            sims = _likeness(m[low : low + 1024], m)
            sims[np.arange(len(sims)), low + np.arange(len(sims))] = -np.inf
            k = min(degree, len(ids) - 1)
            if k < 1:
                break
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            out.append(pd.DataFrame({"u": np.repeat(ids[low : low + 1024], k), "c": ids[best].ravel(), "s": np.take_along_axis(sims, best, 1).ravel(), "fresh": True}))
        return pd.concat(out) if out else pd.DataFrame({"u": [], "c": [], "s": [], "fresh": []}).astype({"u": "int64", "c": "int64", "s": "float64", "fresh": bool})

    return run


def _meet(cell: pd.DataFrame) -> pd.DataFrame:
    """Proposals among the nodes that meet at each v: (u, c, s), better than u's worst neighbour."""
    cell = cell.sort_values("v", kind="stable")
    v, ids, fresh, worst, m = cell["v"].to_numpy(), cell["u"].to_numpy(), cell["fresh"].to_numpy(dtype=bool), cell["worst"].to_numpy(dtype=np.float64), _vectors(cell["q"])
    bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])), [len(v)]]) if len(v) else np.zeros(1, dtype=int)
    us, cs, ss = [], [], []
    for low, high in zip(bounds[:-1], bounds[1:]):
        if high - low < 2 or not fresh[low:high].any():
            continue
        own, f = m[low:high], fresh[low:high]
        sims = _likeness(own, own)
        sims[~(f[:, None] | f[None, :])] = -np.inf
        sims[ids[low:high, None] == ids[None, low:high]] = -np.inf
        k = min(PROPOSALS, high - low - 1)
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        s = np.take_along_axis(sims, best, 1)
        i, j = np.nonzero(s > worst[low:high, None])
        us.append(ids[low + i])
        cs.append(ids[low + best[i, j]])
        ss.append(s[i, j])
    if not us:
        return pd.DataFrame({"u": [], "c": [], "s": []}).astype({"u": "int64", "c": "int64", "s": "float64"})
    u, c, s = np.concatenate(us), np.concatenate(cs), np.concatenate(ss)
    # Nodes of one cell have neighbours in common: the same proposal once.
    order = np.lexsort((c, u))
    u, c, s = u[order], c[order], s[order]
    new = np.concatenate([[True], (u[1:] != u[:-1]) | (c[1:] != c[:-1])])
    return pd.DataFrame({"u": u[new], "c": c[new], "s": s[new]})


def _merge(degree: int):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        u, c, s, fresh = _best(cell["u"].to_numpy(), cell["c"].to_numpy(), cell["s"].to_numpy(), cell["fresh"].to_numpy(dtype=bool), degree)
        return pd.DataFrame({"u": u, "c": c, "s": s, "fresh": fresh})

    return run


def _cells(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    """(node, q, cell): cells of at most about CELL nodes whose vectors lie on the same side of random planes; those of
    one side that are too many are dealt out at random."""
    bits = max(1, int(2 * n / CELL).bit_length() - 1)

    @F.pandas_udf("long")
    def side(qs: pd.Series) -> pd.Series:
        m = _vectors(qs)[:, :-1] if len(qs) else np.empty((0, 1))
        planes = np.random.default_rng(seed).normal(size=(m.shape[1], bits))
        return pd.Series(((m @ planes > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64))).astype(np.int64))

    sided = staged(vectors.select("node", "q", side("q").alias("side")), "graph-sides")
    parts = sided.groupBy("side").agg(F.ceil(F.count("*") / CELL).alias("parts"))
    # At most 2 ** bits rows.
    dealt = sided.join(near(parts, 2**bits), "side")
    return dealt.select("node", "q", F.xxhash64("side", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("parts"))).alias("cell"))


def neighbour_graph(vectors: DataFrame, degree: int = DEGREE, reverse: int = REVERSE, rounds: int | None = None) -> DataFrame:
    """(u, c, s, fresh) by NN-descent: at most `degree` neighbours c of each node u of vectors(node, q). It ends when a round
    changes hardly an edge, or after `rounds`."""
    n = vectors.count()
    cells = max(2, n // CELL)
    schema = "u long, c long, s double, fresh boolean"
    cell = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(cells))
    by_chance = vectors.withColumn("cell", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(cells)))
    # Different ways of dealing nodes to cells tie the cells to one another; else no round could leave a cell.
    starts = [dealt.groupBy("cell").applyInPandas(_start(degree // 2), schema) for dealt in (_cells(vectors, n, 3), _cells(vectors, n, 4), by_chance)]
    graph = starts[0].unionByName(starts[1]).unionByName(starts[2]).groupBy(cell("u").alias("cell")).applyInPandas(_merge(degree), schema)
    graph = staged(graph, "graph")
    for round_ in itertools.count() if rounds is None else range(rounds):
        order = Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("u", F.lit(round_)), "u")
        back = graph.select(F.col("c").alias("v"), F.col("u"), "fresh").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= reverse).drop("r")
        meeting = graph.select(F.col("u").alias("v"), F.col("c").alias("u"), "fresh").unionByName(back).groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
        # Where nobody is new, all have met.
        at = staged(meeting, "graph-meeting")
        lively = staged(at.filter("fresh").select("v").distinct(), "graph-lively")
        meeting = at.join(near(lively, n), "v", "left_semi")
        worst = graph.groupBy("u").agg(F.when(F.count("*") >= degree, F.min("s")).otherwise(F.lit(float("-inf"))).alias("worst"))
        known = staged(vectors.join(worst, vectors["node"] == worst["u"], "left").select("node", "q", F.coalesce("worst", F.lit(float("-inf"))).alias("worst")), "graph-known")
        met = meeting.join(known, meeting["u"] == known["node"]).select("v", "u", "fresh", "worst", "q")
        proposals = met.groupBy(cell("v").alias("cell")).applyInPandas(_meet, "u long, c long, s double")
        both = graph.withColumn("fresh", F.lit(False)).unionByName(proposals.withColumn("fresh", F.lit(True)))
        before, graph = graph, staged(both.groupBy(cell("u").alias("cell")).applyInPandas(_merge(degree), schema), "graph")
        discard(before, at, lively, known)
        # Done when a round changes hardly an edge.
        fresh, edges = graph.agg(F.count_if("fresh"), F.count("*")).first()
        if fresh <= SETTLED * edges:
            break
    return graph


@F.pandas_udf(DoubleType())
def _inner(a: pd.Series, b: pd.Series) -> pd.Series:
    """Inner products without the added component: those of the vectors themselves."""
    return pd.Series((_vectors(a)[:, :-1] * _vectors(b)[:, :-1]).sum(axis=1) if len(a) else np.empty(0))


@F.pandas_udf(DoubleType())
def _exact(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series((np.array(a.tolist(), dtype=np.float64) * np.array(b.tolist(), dtype=np.float64)).sum(axis=1) if len(a) else np.empty(0))


def greedy_search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, longest: DataFrame, beam: int, expand: int) -> DataFrame:
    """(node, found): for each query node of queries(node), the beam of the best nodes found, itself included. Searches
    begin at the query and at the first of longest(node, square)."""
    # Edges serve both ways: a node also leads to some of those that name it.
    order = Window.partitionBy("c").orderBy(F.desc("s"), "u")
    back = graph.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= REVERSE).select(F.col("c").alias("u"), F.col("u").alias("c"))
    edges = staged(graph.select("u", "c").unionByName(back).groupBy("u").agg(F.collect_set("c").alias("cs")), "graph-edges")
    own = queries.join(vectors, "node").select(F.col("node").alias("query"), F.col("q").alias("query_q"))
    state = own.select("query", F.col("query").alias("found"), F.lit(float("inf")).alias("s"), F.lit(False).alias("done"))
    # At most ENTRIES rows.
    longest = F.broadcast(staged(longest.orderBy(F.desc("square"), "node").limit(ENTRIES).select("node").join(vectors, "node"), "search-entries"))
    met = own.crossJoin(longest).filter(F.col("node") != F.col("query")).select("query", F.col("node").alias("found"), _inner("q", "query_q").alias("s"), F.lit(False).alias("done"))
    state = state.unionByName(met)
    while True:
        by_best = Window.partitionBy("query").orderBy("done", F.desc("s"), "found")
        state = staged(state.withColumn("now", ~F.col("done") & (F.row_number().over(by_best) <= expand)), "search-beam")
        if not state.filter("now").head(1):
            break
        step = state.filter("now").select("query", "found").join(edges, F.col("found") == F.col("u")).select("query", F.explode("cs").alias("found")).distinct()
        scored = step.join(vectors, step["found"] == vectors["node"]).join(own, "query").select("query", "found", _inner("q", "query_q").alias("s"), F.lit(False).alias("done"))
        both = state.select("query", "found", "s", (F.col("done") | F.col("now")).alias("done")).unionByName(scored)
        both = both.groupBy("query", "found").agg(F.max("s").alias("s"), F.max("done").alias("done"))
        best = Window.partitionBy("query").orderBy(F.desc("s"), "found")
        state = both.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= beam).drop("r")
    return state.select(F.col("query").alias("node"), "found")


def exact_neighbours(good: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of all good(id, v) for each of asked(id, v), by blocks of queries against
    blocks of rows: the way to whole results where an index may not miss any."""
    q_blocks, r_blocks = max(1, -(-asked.count() // EXACT_QUERIES)), max(1, -(-good.count() // EXACT_ROWS))

    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        ids, out = rows["id"].to_numpy(dtype=np.int64), []
        m = np.array(rows["v"].tolist(), dtype=np.float64)
        for low in range(0, len(queries) if len(rows) else 0, 256):
            some = queries.iloc[low : low + 256]
            own = some["id"].to_numpy(dtype=np.int64)
            scores = np.array(some["v"].tolist(), dtype=np.float64) @ m.T
            scores[own[:, None] == ids[None, :]] = -np.inf
            for i, query in enumerate(own):
                top = np.lexsort((ids, -scores[i]))[:k]
                top = top[scores[i, top] > -np.inf]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[top], "score": scores[i, top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    queries = asked.withColumns({"qb": block(q_blocks), "rb": F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1)))}).groupBy("qb", "rb")
    rows = good.withColumns({"rb": block(r_blocks), "qb": F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))}).groupBy("qb", "rb")
    found = queries.cogroup(rows).applyInPandas(best, "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(rows: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", beam: int = 200, expand: int = 32, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `rows` for which is_query(id column) holds, the k nearest found
    among all other rows, by inner product in double precision, nearest first, ties to the smaller id.

    Null, zero and non-finite vectors, vectors with null components or of another length than most, and rows without
    id take no part. Of rows that repeat an id the one with the least vector counts. Rows with equal vectors are one
    node of the graph, found together; only the k + 1 smallest ids of a node can be among anyone's k nearest with ties
    to smaller ids, and these are kept. Fewer than k candidates are all returned; an empty table gives no rows. A
    search ends when all of a query's `beam` best nodes are expanded. exact: all rows instead of the index.
    """
    good = staged(usable(rows, id_column, vector).groupBy("id").agg(F.min("v").alias("v")), "ann-rows")
    if exact:
        return exact_neighbours(good, good.filter(is_query(F.col("id"))), k)
    by_vector = Window.partitionBy("v").orderBy("id")
    members = good.withColumn("r", F.row_number().over(by_vector)).filter(F.col("r") <= k + 1)
    nodes = staged(members.groupBy("v").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids")), "ann-nodes")
    vectors = staged(_quantised(nodes), "ann-vectors")
    graph = neighbour_graph(vectors)
    longest = nodes.select("node", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("square"))
    asked = good.filter(is_query(F.col("id"))).select("id", "v").join(nodes.select("node", F.col("v").alias("nv")), F.col("v") == F.col("nv")).select("id", "node")
    asked = staged(asked, "ann-queries")
    found = staged(greedy_search(graph, vectors, asked.select("node").distinct(), longest, beam, expand), "ann-found")
    # Exact scores of the beam by node, then the members of the nodes for each query.
    a, b = nodes.select("node", F.col("v").alias("query_v")), nodes.select(F.col("node").alias("found"), "v", "ids")
    scored = found.join(a, "node").join(b, "found").select("node", "ids", _exact("v", "query_v").alias("score"))
    best = Window.partitionBy("node").orderBy(F.desc("score"), F.element_at("ids", 1))
    scored = scored.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("node", "score", F.explode("ids").alias("vec_id"))
    # All queries of a node share its best k + 1 candidates; each then leaves itself out.
    best = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    top = staged(scored.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r"), "ann-top")
    out = asked.join(top, "node").filter(F.col("id") != F.col("vec_id"))
    rank = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
