"""Arithmetic on ``array<float>`` vectors, in double precision and inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Added to a norm before dividing, so that a zero vector stays zero. Fixed value.
EPSILON = 1e-12


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def literal(vector: Sequence[float]) -> Column:
    """A constant ``array<double>``."""
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column | str) -> Column:
    """Scale to unit length; store the result, so that a dot product later is the cosine."""
    col = _column(v)
    # The length as a second array: inside the function it would be computed again for every entry.
    length = F.array_repeat(norm(col) + F.lit(EPSILON), F.size(col))
    return F.zip_with(col, length, lambda x, n: x.cast("double") / n)


def to_float(v: Column | str) -> Column:
    return _column(v).cast("array<float>")


def is_valid(v: Column | str, dim: int) -> Column:
    """True for a present vector of exactly ``dim`` entries, none of them null."""
    col = _column(v)
    return F.coalesce((F.size(col) == dim) & ~F.exists(col, lambda x: x.isNull()), F.lit(False))


def argmax(probabilities: Column | str, classes: Sequence[str]) -> Column:
    """Class name at the first position of the greatest entry."""
    col = _column(probabilities)
    position = F.array_position(col, F.array_max(col)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in classes]), position)
