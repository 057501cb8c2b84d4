"""Vector arithmetic on arrays, inside the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of one matrix with all of another; NaN where a row is zero."""
    with np.errstate(invalid="ignore", divide="ignore"):
        a, b = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] for x in (a, b))
    return a @ b.T


cosine.of_tiles = _cosines


def l1(a: Column, b: Column) -> Column:
    """The negated L1 distance, so that larger is closer."""
    return -total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2(a: Column, b: Column) -> Column:
    """The negated squared distance, so that larger is closer."""
    return -squared_distance(a, b)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x, n))


def affine(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """x W + b for a weight matrix given by columns of outputs."""
    return F.array(*[dot(x, F.array(*[F.lit(float(v)) for v in w])) + F.lit(float(b)) for w, b in zip(weights, bias, strict=True)])


def mean_pool(frames: Column) -> Column:
    """The mean over time of an array of equally long vectors, position by position."""
    n = F.size(frames)
    zeros = F.transform(F.get(frames, F.lit(0)), lambda _: F.lit(0.0))
    added = F.aggregate(frames, zeros, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.when(n > 0, F.transform(added, lambda x: x / n))


SIMILARITIES = {"ip": dot, "cs": cosine, "l1": l1, "l2": l2}
