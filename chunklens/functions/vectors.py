"""Vector columns (arrays of numbers), summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to a norm before division.
EPS = 1e-8


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Divided by its norm plus EPS."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / (n + EPS)))[0]


def clamp_normalize(v: Column, least: float = 1e-12) -> Column:
    """Divided by its norm, or by ``least`` if that is more."""
    return F.transform(F.array(F.greatest(norm(v), F.lit(least))), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + EPS) * (norm(b) + EPS))


def pad(v: Column, size: int) -> Column:
    """Zeros appended up to a size, or cut to it."""
    return F.slice(F.concat(_double(v), F.array_repeat(F.lit(0.0), size)), 1, size)


def finite(v: Column) -> Column:
    """True if all components are numbers, and finite."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def pool(vectors: Column, how: str) -> Column:
    """Mean, max, first or last of an array of vectors of one size."""
    if how == "first":
        return _double(F.try_element_at(vectors, F.lit(1)))
    if how == "last":
        return _double(F.try_element_at(vectors, F.lit(-1)))
    n = F.size(vectors)
    dims = F.sequence(F.lit(0), F.size(vectors[0]) - 1)
    of = lambda d: F.transform(vectors, lambda v: v[d].cast("double"))
    if how == "max":
        return F.when(n > 0, F.transform(dims, lambda d: F.array_max(of(d))))
    if how == "mean":
        return F.when(n > 0, F.transform(dims, lambda d: F.aggregate(of(d), F.lit(0.0), lambda s, x: s + x) / n))
    raise ValueError(f"unknown pooling: {how}")


def cosine_distance_gaps(vectors: Column) -> Column:
    """1 - cosine between each vector of an array and the next."""
    n = F.size(vectors)
    at = F.when(n > 1, F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: 1 - cosine(vectors[i], vectors[i + 1]))
