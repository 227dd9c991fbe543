"""Distances between vectors as columns, in double precision; smaller is closer."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument

METRICS = ("cosine", "euclidean", "dot")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def vector_literal(v: Sequence[float]) -> Column:
    """A constant array<double>."""
    return F.array(*[F.lit(float(x)) for x in v])


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products, in double."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    """Euclidean length, in double."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Cosine distance (1.0 if either is all zeros), Euclidean distance or negated inner product.

    Null vectors and vectors of different lengths give null.
    """
    if metric == "cosine":
        n = norm(a) * norm(b)
        out = F.when(n == 0, F.lit(1.0)).otherwise(1 - inner_product(a, b) / F.when(n != 0, n))
    elif metric == "euclidean":
        out = norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))
    elif metric == "dot":
        out = -inner_product(a, b)
    else:
        raise InvalidArgument(f"metric must be one of {METRICS}, not {metric!r}")
    return F.when(F.size(a) == F.size(b), out)


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(rows of x, rows of q) distances in double, for whole batches."""
    x, q = x.astype(np.float64), q.astype(np.float64)
    if metric == "dot":
        return -(x @ q.T)
    if metric == "euclidean":
        return np.sqrt(np.maximum(((x * x).sum(1)[:, None] - 2 * (x @ q.T)) + (q * q).sum(1)[None], 0))
    n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None]
    return np.where(n == 0, 1.0, 1 - (x @ q.T) / np.where(n == 0, 1, n))
