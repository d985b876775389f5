"""Vectors as arrays: cosine similarity and mean direction as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine within -1 and 1; 0 where a norm is 0; null where lengths differ or a vector is null."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    value = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))
    return F.when(F.size(a) == F.size(b), value)


def mean_direction(vectors: list[Column]) -> Column:
    """Unit vector of the mean of unit vectors; the first one where the mean is zero."""
    total = vectors[0]
    for v in vectors[1:]:
        total = F.zip_with(total, v, lambda x, y: x + y)
    size = F.sqrt(dot(total, total))
    return F.when(size == 0, vectors[0]).otherwise(F.transform(total, lambda x: x / size))
