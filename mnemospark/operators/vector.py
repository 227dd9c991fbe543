"""Exact vector search, its filtered forms, search for many queries at once, and an inverted-list index."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DimensionMismatch, InvalidArgument
from ..functions.distance import METRICS, distance, distances, vector_literal
from ..session import cut, scratch
from .filters import compile_filter, metadata_variant

#: A filtered search in ``overfetch`` mode looks at so many times k rows, at least so many.
OVERFETCH, OVERFETCH_LEAST = 10, 50
#: Queries that a task holds at once; more are taken in blocks, each against all rows.
BLOCK = 4096


def score(df: DataFrame, query: Sequence[float], metric: str = "cosine", dim: int | None = None) -> DataFrame:
    """``df`` with the distance ``score`` of its ``vector`` to the query; rows of another length are left out."""
    if dim is not None and len(query) != dim:
        raise DimensionMismatch(dim, len(query))
    return df.withColumn("score", distance(F.col("vector"), vector_literal(query), metric)).filter("score IS NOT NULL")


def vector_search(df: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine", filter: dict | None = None, mode: str = "prefilter", dim: int | None = None) -> DataFrame:
    """The k rows of (id, vector[, metadata JSON]) nearest to the query: (id, score, metadata), ascending, ties by id.

    ``prefilter`` applies the filter to all rows. ``overfetch`` looks at the nearest max(10 k, 50) rows and may so return
    fewer than k although more match.
    """
    if mode not in ("prefilter", "overfetch"):
        raise InvalidArgument(f"no mode {mode!r}")
    if "metadata" not in df.columns:
        df = df.withColumn("metadata", F.lit(None).cast("string"))
    rows = score(df, query, metric, dim).select("id", "score", "metadata")
    if filter is None:
        return rows.orderBy("score", "id").limit(k)
    keep = compile_filter(filter, metadata_variant(F.col("metadata")))
    if mode == "overfetch":
        rows = rows.orderBy("score", "id").limit(max(OVERFETCH * k, OVERFETCH_LEAST))
    return rows.filter(keep).orderBy("score", "id").limit(k)


def _blocks(rows, size: int) -> Iterator[list]:
    block = []
    for r in rows:
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def knn_join(queries: DataFrame, base: DataFrame, k: int = 10, metric: str = "cosine", block: int = BLOCK, include_self: bool = False) -> DataFrame:
    """For each row (id, vector) of ``queries`` its k nearest rows of ``base``: (query_id, id, score, rank).

    Exact. The queries go to the tasks in blocks; each task keeps k rows for each query, which a window then merges, so
    what is shuffled is k rows for each query and task. Without ``include_self`` a row isn't its own neighbour.
    """
    if metric not in METRICS:
        raise InvalidArgument(f"metric must be one of {METRICS}, not {metric!r}")
    kind = base.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    rows = base.filter("id IS NOT NULL AND vector IS NOT NULL").select("id", F.col("vector").cast("array<float>").alias("vector"))
    wanted = queries.filter("id IS NOT NULL AND vector IS NOT NULL").select("id", F.col("vector").cast("array<float>").alias("vector")).orderBy("id").toLocalIterator()
    out = None
    for rows_of in _blocks(wanted, block):
        by_dim: dict[int, tuple[list, np.ndarray]] = {}
        for dim in {len(v) for _, v in rows_of}:
            ids = [i for i, v in rows_of if len(v) == dim]
            by_dim[dim] = ids, np.array([v for _, v in rows_of if len(v) == dim], np.float64)
        one = rows.mapInArrow(_nearest(by_dim, k, metric, include_self), schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = base.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy("score", "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _nearest(by_dim, k: int, metric: str, include_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list] = {}
        id_type = None
        for b in batches:
            id_type = b.schema.field("id").type
            vec = b.column("vector")
            lengths, starts, flat = vec.value_lengths().to_numpy(), vec.offsets.to_numpy(), vec.values.to_numpy(zero_copy_only=False)
            ids = b.column("id").to_pylist()
            for dim, (query_ids, q) in by_dim.items():
                at = np.flatnonzero(lengths == dim)
                if not len(at):
                    continue
                d = distances(flat[starts[at][:, None] + np.arange(dim)], q, metric)
                for j, query_id in enumerate(query_ids):
                    take = np.arange(len(at)) if len(at) <= k + 1 else np.flatnonzero(d[:, j] <= np.partition(d[:, j], k)[k])
                    rows = [(float(d[i, j]), ids[at[i]]) for i in take.tolist() if include_self or ids[at[i]] != query_id]
                    best[dim, j] = sorted(best.get((dim, j), []) + rows)[:k]
        found = [(by_dim[dim][0][j], i, s) for (dim, j), rows in best.items() for s, i in rows]
        if found:
            a, b_, c = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b_, id_type), pa.array(c, pa.float64())], names=["query_id", "id", "score"])

    return run


def _directions(x: np.ndarray, metric: str) -> np.ndarray:
    """For cosine, vectors of length one; zeros stay."""
    if metric != "cosine" or not len(x):
        return x
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _nearest_list(vec: pa.Array, centres: np.ndarray, metric: str) -> np.ndarray:
    """The nearest centre of each vector of an Arrow list array; vectors of another length go to list 0."""
    n, dim = len(vec), centres.shape[1]
    own = np.zeros(n, np.int32)
    lengths, starts, flat = vec.value_lengths().fill_null(-1).to_numpy(), vec.offsets.to_numpy(), vec.values.to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    for at in range(0, len(rows), 4096):
        part = rows[at : at + 4096]
        x = flat[starts[part][:, None] + np.arange(dim)].astype(np.float64)
        own[part] = distances(_directions(x, metric), centres, "euclidean").argmin(1)
    return own


class ListIndex:
    """Approximate search: rows in lists by their nearest centre; a query looks into the ``probes`` nearest lists.

    Centres are fitted by k-means on at most ``fit_rows`` rows; every row is indexed. Rows are written to ``path`` (a new
    folder below the shared one unless given), partitioned by list, so a search reads the probed folders only. An index is
    opened again by :meth:`open`. :meth:`add` and :meth:`remove` append: with each row goes a mark to a list of its own,
    and of an id only the row of its last mark counts, so nothing is rewritten until the index is built anew.
    """

    MARKS = -1

    def __init__(self, df: DataFrame, lists: int = 64, metric: str = "cosine", fit_rows: int = 20_000, rounds: int = 8, seed: int = 3, path: str | None = None):
        self.spark, self.metric = df.sparkSession, metric
        usable = df.filter("id IS NOT NULL AND vector IS NOT NULL")
        n = usable.count()
        part = usable if n <= fit_rows else usable.sample(min(1.0, 1.2 * fit_rows / n), seed)
        x = _directions(np.array([r[0] for r in part.select(F.col("vector").cast("array<double>")).limit(fit_rows).collect()], float), metric)
        rng = np.random.default_rng(seed)
        centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)] if len(x) else np.zeros((1, 1))
        for _ in range(rounds if len(x) else 0):
            own = distances(x, centres, "euclidean").argmin(1)
            for c in range(len(centres)):
                if (own == c).any():
                    centres[c] = x[own == c].mean(0)
        self.centres, self.path = centres, path or scratch(self.spark, "lists")
        self.spark.createDataFrame([(i, [float(v) for v in c], metric) for i, c in enumerate(centres)], "list int, centre array<double>, metric string").coalesce(1).write.parquet(f"{self.path}/centres")
        self._write(usable, 0)

    @classmethod
    def open(cls, spark, path: str) -> "ListIndex":
        """The index that was written to ``path``."""
        out = cls.__new__(cls)
        rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # one row for each list
        out.spark, out.path, out.metric, out.centres = spark, path, rows[0]["metric"], np.array([r["centre"] for r in rows])
        return out

    def _write(self, usable: DataFrame, seq: int) -> None:
        if "metadata" not in usable.columns:
            usable = usable.withColumn("metadata", F.lit(None).cast("string"))
        rows = usable.select("id", F.col("vector").cast("array<float>").alias("vector"), F.col("metadata").cast("string").alias("metadata"))
        schema, centres, metric = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())]), self.centres, self.metric

        def assign(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_nearest_list(b.column("vector"), centres, metric))], names=[*b.schema.names, "list"])

        listed = rows.mapInArrow(assign, schema).withColumn("seq", F.lit(seq).cast("long"))
        if not seq:
            listed.repartition("list").write.mode("append").partitionBy("list").parquet(f"{self.path}/rows")
            return
        listed = cut(listed)
        marks = listed.withColumn("list", F.lit(self.MARKS)).withColumn("vector", F.lit(None).cast("array<float>")).withColumn("metadata", F.lit(None).cast("string"))
        listed.unionByName(marks).repartition("list").write.mode("append").partitionBy("list").parquet(f"{self.path}/rows")

    def add(self, df: DataFrame, seq: int) -> None:
        """Insert or replace the rows of ``df``; ``seq`` is above that of every call before."""
        self._write(df.filter("id IS NOT NULL AND vector IS NOT NULL"), seq)

    def remove(self, ids: DataFrame, seq: int) -> None:
        """Leave the ids of ``ids`` (id) out from now on."""
        kind = self.rows.schema["id"].dataType
        ids.select(F.col("id").cast(kind).alias("id"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("metadata"), F.lit(seq).cast("long").alias("seq"), F.lit(self.MARKS).alias("list")).write.mode("append").partitionBy("list").parquet(f"{self.path}/rows")

    @property
    def rows(self) -> DataFrame:
        """What is written: (id, vector, metadata, seq, list)."""
        return self.spark.read.parquet(f"{self.path}/rows")

    def probed(self, query: Sequence[float], probes: int) -> DataFrame:
        """The rows of the ``probes`` lists nearest to the query, the valid ones."""
        near = distances(_directions(np.array([query], float), self.metric), self.centres, "dot" if self.metric == "dot" else "euclidean")[0].argsort()[:probes]
        rows = self.rows
        here = rows.filter(F.col("list").isin([int(c) for c in near])).drop("list")
        marks = rows.filter(F.col("list") == self.MARKS).groupBy("id").agg(F.max("seq").alias("_last"))
        return here.join(marks, "id", "left").filter("seq = coalesce(_last, 0)").drop("_last", "seq")

    def search(self, query: Sequence[float], k: int = 10, probes: int = 8, filter: dict | None = None) -> DataFrame:
        """(id, score, metadata) of the k nearest rows in the probed lists."""
        return vector_search(self.probed(query, probes), query, k, self.metric, filter)

    def knn_join(self, queries: DataFrame, k: int = 10, probes: int = 8, include_self: bool = False) -> DataFrame:
        """(query_id, id, score, rank): for each row (id, vector) the k nearest rows of its ``probes`` nearest lists.

        A query goes to its lists by a join on the list, so neither side passes through the driver or is held by a task.
        """
        centres, metric = self.centres, self.metric

        def lists(batches):
            for b in batches:
                if b.num_rows:
                    x = _directions(np.array(b.column("vector").to_pylist(), float), metric)
                    near = distances(x, centres, "dot" if metric == "dot" else "euclidean").argsort(1)[:, :probes].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), near.ravel())], names=[*b.schema.names, "lists"])

        dim = centres.shape[1]
        asked = queries.filter("id IS NOT NULL AND vector IS NOT NULL").select("id", F.col("vector").cast("array<float>").alias("vector")).filter(F.size("vector") == dim)
        asked = asked.mapInArrow(lists, T.StructType([*asked.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))]))
        asked = asked.select(F.col("id").alias("query_id"), F.col("vector").alias("_q"), F.explode("lists").alias("list"))
        rows = self.rows
        marks = rows.filter(F.col("list") == self.MARKS).groupBy("id").agg(F.max("seq").alias("_last"))
        base = rows.filter(F.col("list") >= 0).join(marks, "id", "left").filter("seq = coalesce(_last, 0)").select("id", "vector", "list")
        both = asked.join(base, "list")
        both = both if include_self else both.filter(F.col("query_id") != F.col("id"))
        scored = both.select("query_id", "id", distance(F.col("vector"), F.col("_q"), metric).alias("score")).filter("score IS NOT NULL")
        w = Window.partitionBy("query_id").orderBy("score", "id")
        return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def upsert(current: DataFrame, batch: DataFrame, keys: Sequence[str] = ("id",), order: Column | None = None) -> DataFrame:
    """``current`` with the rows of ``batch`` in place of those with the same keys; ``created_at`` of a known key is kept.

    Within the batch the last row of a key by ``order`` counts (all columns if there is none). Nulls in the batch replace
    values. Both need the same columns.
    """
    last = F.max(F.struct((order if order is not None else F.lit(0)).alias("_o"), *[F.col(c) for c in batch.columns if c not in keys])).alias("_r")
    new = batch.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in batch.columns if c not in keys])
    if "created_at" in current.columns:
        known = current.select(*keys, F.col("created_at").alias("_made"))
        new = new.join(known, list(keys), "left").withColumn("created_at", F.coalesce("_made", "created_at")).drop("_made")
    return current.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*current.columns))


def collection_stats(collections: DataFrame, vectors: DataFrame) -> DataFrame:
    """(name, dim, metric, count) of every collection, by name."""
    n = vectors.groupBy("collection_id").agg(F.count("*").alias("count"))
    rows = collections.join(n, collections.id == n.collection_id, "left")
    return rows.select("name", "dim", "metric", F.coalesce("count", F.lit(0)).alias("count")).orderBy("name")
