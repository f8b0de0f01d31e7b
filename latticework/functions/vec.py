"""Numeric helpers: portable rounding and dense-vector arithmetic inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column, digits: int = 4) -> Column:
    """Round half up on the binary value, which other engines repeat exactly; null stays null."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def doubles(v: Column) -> Column:
    """A vector in double precision."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; the shorter vector's missing values count as null, which makes the result null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Cosine similarity; null where a norm is 0 and ``eps`` is 0."""
    size = norm(a) * norm(b) + F.lit(eps)
    return F.when(size != 0, dot(a, b) / size)


def clip(x: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Bound ``x``; null stays null."""
    out = x
    if low is not None:
        out = F.when(x.isNotNull(), F.greatest(out, F.lit(low)))
    if high is not None:
        out = F.when(x.isNotNull(), F.least(out, F.lit(high)))
    return out


def mean_vector(vectors: Column, dim: int) -> Column:
    """Element-wise mean of an array of vectors."""
    n = F.size(vectors)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.get(v, i)) / n)
