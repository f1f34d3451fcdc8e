"""Distances between vectors: as Column expressions for single queries, as numpy for blocks."""

from __future__ import annotations

from collections.abc import Callable

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of the components; the longer vector is cut to the length of the shorter."""
    n = F.least(F.size(a), F.size(b))
    d = lambda x: x.cast("double")
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: f(d(x), d(y)))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(l2(a, b))


def l1(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    """Largest difference of components; 0 for empty vectors."""
    return F.coalesce(F.array_max(_pairs(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0))


def neg_dot(a: Column, b: Column) -> Column:
    return -_sum(_pairs(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine; 0 if a norm is 0."""
    norm = _sum(_pairs(a, b, lambda x, y: x * x)) * _sum(_pairs(a, b, lambda x, y: y * y))
    return F.when(norm == 0, 0.0).otherwise(1 + neg_dot(a, b) / F.sqrt(norm))


def hamming(a: Column, b: Column) -> Column:
    """Number of unequal components."""
    return F.size(F.filter(_pairs(a, b, lambda x, y: (x != y).cast("double")), lambda x: x > 0))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"l2": l2, "euclidean": euclidean, "l1": l1, "chebyshev": chebyshev, "neg_dot": neg_dot, "cosine": cosine, "hamming": hamming}


def _blocks(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Applies ``f`` to pairs of rows in pieces that keep the difference tensor small."""

    def g(q: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = max(1, 4_000_000 // max(1, b.size))
        return np.concatenate([f(q[i : i + step, None, :], b[None]) for i in range(0, len(q), step)]) if len(q) else np.zeros((0, len(b)))

    return g


def _products(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by matrix products; where they are small beside the norms, from the differences."""
    nq, nb = (q * q).sum(1)[:, None], (b * b).sum(1)[None]
    d = nq + nb - 2 * (q @ b.T)
    close = np.argwhere(d <= 1e-6 * (nq + nb))
    for a in range(0, len(close), 100_000):
        i, j = close[a : a + 100_000].T
        d[i, j] = ((q[i] - b[j]) ** 2).sum(1)
    return d


def _cosine(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    norm = (q * q).sum(1)[:, None] * (b * b).sum(1)[None]
    return np.where(norm == 0, 0.0, 1 - q @ b.T / np.sqrt(np.where(norm == 0, 1.0, norm)))


#: The same as (queries, vectors) -> distance matrices over double arrays.
BLOCK_METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "l2": _products,
    "euclidean": lambda q, b: np.sqrt(_products(q, b)),
    "l1": _blocks(lambda q, b: np.abs(q - b).sum(-1)),
    "chebyshev": _blocks(lambda q, b: np.abs(q - b).max(-1)),
    "neg_dot": lambda q, b: -(q @ b.T),
    "cosine": _cosine,
    "hamming": _blocks(lambda q, b: (q != b).sum(-1).astype(float)),
}


@dataclass(frozen=True)
class Metric:
    """A distance of one's own: of two array columns, and of blocks (queries, vectors) -> matrix of doubles."""

    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


def metric_of(m: str | Metric) -> Metric:
    return m if isinstance(m, Metric) else Metric(METRICS[m], BLOCK_METRICS[m])
