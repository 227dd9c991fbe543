"""Latest rows and row numbers that no hot key can overload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` for each key, by partial aggregation (a hot key shuffles one row per task).

    Null keys form one key of their own; null order values are smallest. Rows that tie on ``order`` are told apart by
    the remaining columns, so the result never depends on the partitioning. Columns keep their names and order.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*[F.col(f"`{c}`") for c in [*order, *rest]])).alias("_best")
    out = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(best)
    return out.select(*[F.col(f"`{c}`") if c in keys else F.col("_best").getField(c).alias(c) for c in df.columns])


def _parts(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows in range partitions by (keys, order), written to the shared folder, with the number of their part."""
    return cut(df.repartitionByRange(*[F.col(f"`{k}`") for k in keys], *order)).withColumn("_part", F.spark_partition_id())


def _with_parts_before(rows: DataFrame, part: DataFrame, keys: Sequence[str], summary: Column, over_parts) -> DataFrame:
    """``rows`` joined with ``_before``, what ``over_parts`` makes of the summaries of the key's earlier parts."""
    sums = part.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p")).agg(summary.alias("_s"))
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", over_parts(F.col("_s")).over(before)).drop("_s")
    cond = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    return rows.join(sums, cond)


def spread_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``row_number()`` per key, from 1, with no key ever sorted in one task.

    The rows are range-partitioned by (keys, order) and written to the shared folder; each part numbers its own rows and
    adds the number of rows of the key in the parts before it (at most one count per key and part). ``order`` should be
    total within a key; equal rows get arbitrary but distinct numbers.
    """
    part = _parts(df, keys, order)
    own = Window.partitionBy(*[F.col(f"`{k}`") for k in keys], "_part").orderBy(*order)
    out = _with_parts_before(part.withColumn("_n", F.row_number().over(own)), part, keys, F.count("*"), F.sum)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_n") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def spread_best_before(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str, least: bool = False) -> DataFrame:
    """The greatest (or least) ``value`` of the rows of the key that come earlier, null for the first; spread like row numbers."""
    best, either = (F.min, F.least) if least else (F.max, F.greatest)
    part = _parts(df, keys, order)
    own = Window.partitionBy(*[F.col(f"`{k}`") for k in keys], "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = _with_parts_before(part.withColumn("_n", best(value).over(own)), part, keys, best(value), best)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], either("_n", "_before").alias(name))


def spread_sum_before(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """The sum of ``value`` over the rows of the key that come earlier, 0 for the first; spread like row numbers."""
    part = _parts(df, keys, order)
    own = Window.partitionBy(*[F.col(f"`{k}`") for k in keys], "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = _with_parts_before(part.withColumn("_n", F.sum(value).over(own)), part, keys, F.sum(value), F.sum)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.coalesce("_n", F.lit(0)) + F.coalesce("_before", F.lit(0))).alias(name))
