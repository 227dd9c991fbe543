"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _sign(edges: DataFrame):
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component): each node that is an end of an edge, with the smallest node it is connected to.

    Edges are undirected; null ends and self-links are left out (a node with nothing but a self-link doesn't come out);
    repeats don't matter. Large-star hangs every greater neighbour of a node below the least of its neighbourhood,
    small-star does so with the lesser ones; both alternate until the edges stay the same, which takes about
    log(diameter)^2 rounds. The least neighbour of a node is a partial aggregation, so a node with a third of all edges
    sends one row per task; the edges are cut from their lineage in each round.
    """
    e = edges.select(F.col(f"`{src}`").alias("a"), F.col(f"`{dst}`").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())  # v < u
    before = None
    while (now := _sign(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large.filter("u <> v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.filter("u <> v").distinct())
    stars = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots.join(stars.select("node"), "node", "left_anti"))
