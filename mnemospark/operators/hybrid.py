"""Blending of vector, graph and text results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from .fulltext import TextIndex
from .graph import walk
from .vector import OVERFETCH, OVERFETCH_LEAST, vector_search

#: Vector candidates for a blend of k results.
FETCH, FETCH_LEAST = 20, 100


def _min_max(df: DataFrame, value: str, out: str, least: float, invert: bool = False) -> DataFrame:
    """Scale to 0..1 over the rows there are; one row of the extremes is joined to each."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = (F.col(value) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(least))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, 1 - x if invert else x).drop("_lo", "_hi")  # one row


def _min_max_few(df: DataFrame, value: str, out: str, least: float, invert: bool = False) -> DataFrame:
    """:func:`_min_max` for what a limit has left, by a window, so that it is made once."""
    every = Window.partitionBy(F.lit(1))  # at most what was fetched
    lo, hi = F.min(value).over(every), F.max(value).over(every)
    x = (F.col(value) - lo) / F.greatest(hi - lo, F.lit(least))
    return df.withColumn(out, 1 - x if invert else x)


def _vector_channel(vectors: DataFrame, query: Sequence[float], k: int, metric: str, spec: dict | None) -> DataFrame:
    fetch = max(FETCH * k, FETCH_LEAST)
    if spec is None:
        found = vector_search(vectors, query, fetch, metric)
    else:
        # as a filtered search fetches: the nearest 10 * fetch rows first, then the filter
        found = vector_search(vectors, query, max(OVERFETCH * fetch, OVERFETCH_LEAST), metric)
        from .filters import compile_filter, metadata_variant

        found = found.filter(compile_filter(spec, metadata_variant(F.col("metadata")))).orderBy("score", "id").limit(fetch)
    return _min_max_few(found, "score", "vec_sim", 1e-6, invert=True).select("id", "vec_sim", "metadata")


def hybrid_query(vectors: DataFrame, edges: DataFrame, query: Sequence[float], anchor: str, alpha: float = 0.6, depth: int = 2, top_k: int = 10, metric: str = "cosine", filter: dict | None = None, mode: str = "exact") -> DataFrame:
    """(id, score, vector_score, graph_weight, metadata): alpha * similarity + (1 - alpha) * weight, best first.

    Candidates are vector results only, ``max(20 k, 100)`` of them; similarity is min-max scaled over these, graph
    weights are taken as they are, not below 0, and 0 for nodes out of reach.
    """
    near = _vector_channel(vectors, query, top_k, metric, filter)
    reach = walk(edges, [anchor], depth, 0.0, None, mode).select("id", F.greatest("weight", F.lit(0.0)).alias("graph_weight"))
    rows = near.join(reach, "id", "left").withColumn("graph_weight", F.coalesce("graph_weight", F.lit(0.0)))
    rows = rows.select("id", (alpha * F.col("vec_sim") + (1 - alpha) * F.col("graph_weight")).alias("score"), F.col("vec_sim").alias("vector_score"), "graph_weight", "metadata")
    return rows.orderBy(F.desc("score"), "id").limit(top_k)


def tri_modal_query(vectors: DataFrame | None, edges: DataFrame | None, index: TextIndex | None, query: Sequence[float] = (), anchor: str = "", text: str = "", alpha: float = 0.4, beta: float = 0.3, gamma: float = 0.3, depth: int = 2, top_k: int = 10, metric: str = "cosine", filter: dict | None = None, mode: str = "exact") -> DataFrame:
    """(id, score, vector_score, graph_score, text_score, metadata): alpha * vector + beta * graph + gamma * text, best first.

    Candidates are the union of all channels, each min-max scaled over its own results: a single vector result gets 1, a
    single graph or text result 0; what a channel hasn't found adds nothing. A channel with weight 0 or without input
    isn't run, and one whose query can't be parsed is empty. The filter restricts the vector channel only.
    """
    if abs(alpha + beta + gamma - 1) > 0.01:
        raise InvalidArgument("alpha + beta + gamma must be 1")
    spark = next(x.sparkSession if isinstance(x, DataFrame) else x.texts.sparkSession for x in (vectors, edges, index) if x is not None)
    v = spark.createDataFrame([], "id string, vec_sim double, metadata string")
    g = spark.createDataFrame([], "id string, graph_score double")
    t = spark.createDataFrame([], "id string, text_score double")
    fetch = max(FETCH * top_k, FETCH_LEAST)
    if beta > 0 and anchor and edges is not None:
        reach = walk(edges, [anchor], depth, 0.0, None, mode).select("id", F.greatest("weight", F.lit(0.0)).alias("w"))
        g = _min_max(reach, "w", "graph_score", 1e-9).select("id", "graph_score")
    if alpha > 0 and len(query) and vectors is not None:
        v = _vector_channel(vectors, query, top_k, metric, filter)
    if gamma > 0 and text and index is not None:
        try:
            hits = index.search(text, fetch).select(F.col("doc_id").alias("id"), (-F.col("rank")).alias("w"))
            t = _min_max_few(hits, "w", "text_score", 1e-9).select("id", "text_score")
        except InvalidArgument:
            pass
    rows = v.join(g, "id", "full").join(t, "id", "full")
    score = alpha * F.coalesce("vec_sim", F.lit(0.0)) + beta * F.coalesce("graph_score", F.lit(0.0)) + gamma * F.coalesce("text_score", F.lit(0.0))
    rows = rows.select("id", score.alias("score"), F.col("vec_sim").alias("vector_score"), "graph_score", "text_score", "metadata")
    return rows.orderBy(F.desc("score"), "id").limit(top_k)
