"""Metrics and vector functions, as columns and as numpy kernels. A larger score is nearer."""

from __future__ import annotations

from enum import IntEnum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(IntEnum):
    L2 = 0  # squared distance
    INNER_PRODUCT = 1
    COSINE = 2  # a similarity


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def squared_norm(a: str | Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def normalized(a: str | Column) -> Column:
    """Unit length in double; a zero vector stays as it is."""
    n = F.sqrt(squared_norm(a))
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def score(metric: Metric, q: str | Column, v: str | Column) -> Column:
    """Of vectors that are normalized beforehand under COSINE."""
    return -squared_l2(q, v) if metric == Metric.L2 else dot(q, v)


def value(metric: Metric, s: str) -> Column:
    return -F.col(s) if metric == Metric.L2 else F.col(s)


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=x.copy(), where=n > 0)


def scores(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All scores of rows of q against rows of x, by one matrix product."""
    s = q @ x.T
    if metric != Metric.L2:
        return s
    return -np.maximum(0.0, (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * s)
