"""Vector arithmetic as Column functions over array<float>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8
#: Names of metrics.
METRICS = {"cosine": "cosine", "euclidean": "euclidean", "l2": "euclidean", "manhattan": "manhattan", "l1": "manhattan"}


def _c(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x * x)))


def cosine_distance(a, b) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b) + EPSILON)


def euclidean(a, b) -> Column:
    return F.sqrt(_sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)))


def cosine_similarity(a, b) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.when(n == 0, 1.0).otherwise(n))


def normalize(a) -> Column:
    n = norm(a)
    return F.when(n == 0, _c(a)).otherwise(F.transform(_c(a), lambda x: x / n))


def mean_pool(states: str | Column, mask: str | Column) -> Column:
    """The mean of a text's token vectors (array of arrays) where the mask is 1; a zero vector where it never is."""
    states, mask = (F.col(c) if isinstance(c, str) else c for c in (states, mask))
    rows = F.zip_with(states, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    zero = F.transform(states[0], lambda _: F.lit(0.0))
    total = F.aggregate(rows, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    return F.transform(total, lambda x: x / n)


def metric_name(name: str | None) -> str:
    return METRICS.get((name or "").lower(), "cosine")


def distance(a, b, metric: str = "cosine") -> Column:
    return {"cosine": cosine_distance, "euclidean": euclidean, "manhattan": manhattan}[metric_name(metric)](a, b)


def score(d: Column, metric: str = "cosine", clamp: bool = False) -> Column:
    """A distance as a score: 1 - d for cosine (clamp: not under 0), else 1 / (1 + d)."""
    if metric_name(metric) != "cosine":
        return 1 / (1 + d)
    return F.greatest(F.lit(0.0), 1 - d) if clamp else 1 - d
