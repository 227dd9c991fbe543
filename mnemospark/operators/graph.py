"""A directed, typed, weighted graph in two tables: nodes (id, kind, data) and edges (src, dst, relation, weight)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..session import cut
from .ranking import latest_rows


def current_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst, relation), the newest."""
    return latest_rows(edges.select("src", "dst", "relation", "created_at", "weight"), ["src", "dst", "relation"], ["created_at"])


def current_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id, the newest."""
    return latest_rows(nodes, ["id"], ["updated_at", "created_at"])


def walk(edges: DataFrame, starts: Sequence | DataFrame, max_depth: int = 1, min_weight: float | None = None, relation: str | None = None, mode: str = "exact") -> DataFrame:
    """(start, id, depth, weight) of what can be reached from each start along the edges' direction.

    ``depth`` is the fewest hops, at least one (0 counts as 1); ``weight`` the greatest weight of the last edge of any
    simple path of at most ``max_depth`` hops. Edges under ``min_weight`` (0.0 unless given) are left out. A start is
    reached only over an edge to itself. Unknown starts reach nothing. ``starts`` are values or a frame (start) of any size,
    all walked in one plan.

    ``exact`` never enumerates paths. A simple path that ends with the edge u -> v exists if u can be reached in one hop
    less without v. Where u is no farther than v, a shortest way to u doesn't meet v. Only for edges that lead back (v
    nearer than u) and are heavier than all others into v a search that avoids v decides; all of these are searched
    together, level by level. ``bfs`` leaves that out: depth is exact, weight may count an edge that leads back. ``paths``
    enumerates simple paths, whose number grows as the out-degree to the power of the depth; it is the rule to test by.
    One plan without a job until the result is used, for ``paths`` and for depths up to 2.
    """
    if mode not in ("exact", "paths", "bfs"):
        raise InvalidArgument(f"no mode {mode!r}")
    spark = edges.sparkSession
    e = edges.filter(F.col("weight") >= (0.0 if min_weight is None else float(min_weight)))
    if relation is not None:
        e = e.filter(F.col("relation") == relation)
    e = e.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("weight").alias("_w")).filter("_d IS NOT NULL")
    if isinstance(starts, DataFrame):
        begin = starts.select("start").filter("start IS NOT NULL").distinct()
    else:
        # a literal, not a frame made from Python rows, so that no Python worker starts
        kind = edges.schema["src"].dataType
        values = F.array(*[F.lit(s).cast(kind) for s in sorted(set(starts))]).cast(f"array<{kind.simpleString()}>")
        begin = spark.range(0, 1, 1, 1).select(F.explode(values).alias("start"))
    depth = max(max_depth, 1)
    if mode == "paths":
        return _paths(e, begin, depth)
    best = e.groupBy("_s", "_d").agg(F.max("_w").alias("_w"))  # of parallel edges the heaviest counts
    first = begin.join(best, F.col("start") == F.col("_s")).select("start", F.col("_d").alias("id"), F.lit(1).alias("depth"), F.col("_w").alias("weight"))
    if depth == 1:
        return first
    near = first.filter("id <> start")
    if depth == 2:
        step = near.join(best, F.col("id") == F.col("_s")).filter("_d <> start AND _d <> id").select("start", F.col("_d").alias("id"), F.lit(2).alias("depth"), F.col("_w").alias("weight"))
        return first.unionByName(step).groupBy("start", "id").agg(F.min("depth").alias("depth"), F.max("weight").alias("weight"))
    reached = cut(_levels(best, near.select("start", "id", "depth"), ["start"], depth))
    # every edge into what is reached from what is reached in one hop less, the start included
    source = reached.filter(F.col("depth") < depth).select("start", F.col("id").alias("u"), F.col("depth").alias("du"))
    into = source.join(best, F.col("u") == F.col("_s")).filter("_d <> start AND _d <> u").select("start", "u", "du", F.col("_d").alias("id"), F.col("_w").alias("weight"))
    into = into.join(reached, ["start", "id"])
    sure = first.unionByName(into.filter("depth >= du").select("start", "id", "depth", "weight")).groupBy("start", "id").agg(F.min("depth").alias("depth"), F.max("weight").alias("weight"))
    sure = cut(sure)
    back = into.filter("depth < du").select("start", "u", "id", F.col("weight").alias("w")).join(sure.select("start", "id", "weight"), ["start", "id"])
    back = back.filter("w > weight").select("start", "id", "u", "w")
    if mode == "exact":
        back = cut(back)
        if back.isEmpty():
            return sure
        # what the start reaches without the node the edge leads back to
        avoid = back.select("start", F.col("id").alias("avoid")).distinct()
        front = avoid.join(first.select("start", "id", "depth"), "start").filter("id <> avoid AND id <> start")
        around = _levels(best, front, ["start", "avoid"], depth - 1)
        back = back.join(around.select("start", F.col("avoid").alias("id"), F.col("id").alias("u")), ["start", "id", "u"], "left_semi")
    more = back.groupBy("start", "id").agg(F.max("w").alias("w"))
    return sure.join(more, ["start", "id"], "left").select("start", "id", "depth", F.greatest("weight", "w").alias("weight"))


def _levels(best: DataFrame, front: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(*keys, id, depth): the fewest hops to each node, from those of one hop on; neither the start nor what is to be avoided is met."""
    reached = front.groupBy(*keys, "id").agg(F.min("depth").alias("depth"))
    for d in range(2, depth + 1):
        reached = cut(reached)
        step = reached.filter(F.col("depth") == d - 1).join(best, F.col("id") == F.col("_s")).filter(" AND ".join(f"_d <> {k}" for k in keys))
        step = step.select(*keys, F.col("_d").alias("id"), F.lit(d).alias("depth"))
        reached = reached.unionByName(step).groupBy(*keys, "id").agg(F.min("depth").alias("depth"))
    return reached


def _paths(e: DataFrame, begin: DataFrame, max_depth: int) -> DataFrame:
    level = begin.join(e, F.col("start") == F.col("_s")).select("start", F.col("_d").alias("id"), F.lit(1).alias("depth"), F.col("_w").alias("weight"), F.array("start", "_d").alias("seen"))
    levels = [level]
    for depth in range(2, max_depth + 1):
        step = level.join(e, F.col("id") == F.col("_s")).filter(~F.array_contains("seen", F.col("_d")))
        level = step.select("start", F.col("_d").alias("id"), F.lit(depth).alias("depth"), F.col("_w").alias("weight"), F.array_append("seen", F.col("_d")).alias("seen"))
        levels.append(level)
    every = levels[0].select("start", "id", "depth", "weight")
    for x in levels[1:]:
        every = every.unionByName(x.select("start", "id", "depth", "weight"))
    return every.groupBy("start", "id").agg(F.min("depth").alias("depth"), F.max("weight").alias("weight"))


def neighbors(nodes: DataFrame, edges: DataFrame, start: str, max_depth: int = 1, min_weight: float | None = None, relation: str | None = None, mode: str = "exact") -> DataFrame:
    """(id, kind, data, depth, weight) of the nodes in reach, nearest first, then by weight descending, then id."""
    found = walk(edges, [start], max_depth, min_weight, relation, mode).drop("start")
    return nodes.select("id", "kind", "data").join(found, "id").orderBy("depth", F.desc("weight"), "id")


def nodes_by_kind(nodes: DataFrame, kind: str) -> DataFrame:
    """Nodes of one kind."""
    return nodes.filter(F.col("kind") == kind)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: (nodes, edges)."""
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select(F.col("id").alias("_n")).distinct()
    return edges.join(ids, F.col("src") == F.col("_n"), "left_semi").join(ids, F.col("dst") == F.col("_n"), "left_semi")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids in ``gone`` (id) and without the edges at them."""
    g = gone.select(F.col("id").alias("_g")).distinct()
    rest = nodes.join(g, F.col("id") == F.col("_g"), "left_anti")
    kept = edges.join(g, F.col("src") == F.col("_g"), "left_anti").join(g, F.col("dst") == F.col("_g"), "left_anti")
    return rest, kept
