"""Expressions on ``array<float>`` vectors. Arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def to_float32(vector: Column) -> Column:
    """Vectors are stored in single precision."""
    return vector.cast("array<float>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of different length give NULL."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(vector: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_sum(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))


def has_direction(vector: Column) -> Column:
    """True unless the vector is NULL, empty, all zeros, or has a component that
    is NULL, NaN or infinite."""
    finite = F.forall(vector, lambda x: F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.exists(vector, lambda x: x != 0) & finite, F.lit(False))


def l2_normalize(vector: Column) -> Column:
    """Vector divided by its length; a zero vector becomes NULL."""
    # The length enters the lambda as an array element: naming it directly
    # would evaluate it once for every component.
    scaled = F.transform(
        F.array(F.struct(norm(vector).alias("n"), vector.alias("v"))),
        lambda s: F.transform(s["v"], lambda x: F.try_divide(x.cast("double"), s["n"])),
    )
    return F.when(has_direction(vector), scaled[0])


def sq_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    def square_gap(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return _sum(F.zip_with(a, b, square_gap))


def cosine_from_l2(squared_distance: Column) -> Column:
    """Cosine of two unit vectors from their squared distance."""
    return 1.0 - 0.5 * squared_distance


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL if either vector has no direction."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
