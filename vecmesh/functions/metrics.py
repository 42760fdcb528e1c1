"""Distance kernels: as Columns for plans inside the JVM, and over numpy blocks for scans."""

from __future__ import annotations

from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = float(np.finfo(np.float32).eps)


class Metric(Enum):
    """A collection's metric; scores are squared Euclidean distances or 1 - cosine, lower is nearer."""

    L2 = "L2"
    COSINE = "COSINE"

    @classmethod
    def parse(cls, text: str | Metric | None) -> Metric:
        """Case and white space don't matter; blank means L2."""
        if isinstance(text, Metric):
            return text
        name = (text or "").strip().upper() or "L2"
        if name not in cls.__members__:
            raise ValueError(f"unknown metric {text!r}")
        return cls[name]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance in doubles."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """0 if either squared norm is within the float epsilon of 0."""
    na, nb = dot(a, a), dot(b, b)
    return F.when((na <= EPSILON) | (nb <= EPSILON), F.lit(0.0)).otherwise(dot(a, b) / (F.sqrt(na) * F.sqrt(nb)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_similarity(a, b)))


def score(metric: str | Metric, a: Column | str, b: Column | str) -> Column:
    return l2_squared(a, b) if Metric.parse(metric) is Metric.L2 else cosine_distance(a, b)


def normalized(a: Column | str) -> Column:
    """The vector at unit length; zeros where its squared norm is within the float epsilon of 0."""
    norm = F.sqrt(dot(a, a))
    return F.transform(doubles(a), lambda x: F.when(norm * norm <= EPSILON, F.lit(0.0)).otherwise(x / norm))


def block_scores(metric: str | Metric, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of all rows for each query, (queries, rows), rounded so that equal distances tie."""
    if Metric.parse(metric) is Metric.L2:
        out = (queries**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None, :] - 2 * queries @ rows.T
        return np.round(np.maximum(out, 0.0), 9)
    nq, nr = (queries**2).sum(axis=1), (rows**2).sum(axis=1)
    size = np.sqrt(np.maximum(nq, EPSILON))[:, None] * np.sqrt(np.maximum(nr, EPSILON))[None, :]
    cosine = np.where((nq <= EPSILON)[:, None] | (nr <= EPSILON)[None, :], 0.0, queries @ rows.T / size)
    return np.round(1.0 - np.clip(cosine, -1.0, 1.0), 9)
