"""Vector functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector at length 1; null where it is null or all zero."""
    n = F.nullif(norm(a), F.lit(0.0))
    return F.when(n.isNotNull(), F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null, of another length or all zero."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def is_valid(vector: Column, dim: int) -> Column:
    """Whether a vector is given, has dim numbers, and is not all zero."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dim) & F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def stub_embedding(dim: int) -> Column:
    """The vector of the stub model: all zero."""
    return F.array_repeat(F.lit(0.0).cast("float"), dim)
