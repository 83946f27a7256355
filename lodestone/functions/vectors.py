"""Vector arithmetic on array columns, in double precision, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths (and products of lengths) below this count as zero.
TINY = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - similarity, from 0 to 2; 1 where either vector is all but zero."""
    size = norm(a) * norm(b)
    similarity = F.least(F.greatest(dot(a, b) / size, F.lit(-1.0)), F.lit(1.0))
    return F.when(size < TINY, F.lit(1.0)).otherwise(1 - similarity)


def l2_squared(a: Column, b: Column) -> Column:
    """Squared, so without a root."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def distance(space: str, a: Column, b: Column) -> Column:
    try:
        return {"cosine": cosine_distance, "l2": l2_squared}[space](a, b)
    except KeyError:
        raise ValueError(f"space must be cosine or l2, not {space!r}") from None


def l2_normalize(a: Column) -> Column:
    """Divided by its length; unchanged if that is all but zero."""
    size = norm(a)
    return F.when(size > TINY, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def is_finite(a: Column) -> Column:
    return a.isNotNull() & ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def is_valid(a: Column, dim: int) -> Column:
    """Of ``dim`` components, none null, NaN or infinite."""
    return F.coalesce(is_finite(a) & (F.size(a) == dim), F.lit(False))


def checked(a: Column, dim: int) -> Column:
    """``a``; the query fails on a vector that is not valid."""
    return F.when(is_valid(a, dim), a).otherwise(F.raise_error(F.lit(f"a vector is not {dim} finite numbers")))
