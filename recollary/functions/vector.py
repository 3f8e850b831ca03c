"""Vector functions over array<float> columns, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def magnitude(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def usable(a: str | Column, size: int | None = None) -> Column:
    """Not null, finite, not all zero, of the given size."""
    right = (F.size(a) == size) if size else F.size(a) > 0
    finite = F.forall(col(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(right & finite & F.exists(col(a), lambda x: x != 0), F.lit(False))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Clamped to [-1, 1]; 0 for a zero vector, null, or unlike sizes."""
    norm = magnitude(a) * magnitude(b)
    value = F.when((F.size(a) == F.size(b)) & (norm > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))
    return F.coalesce(value, F.lit(0.0))


def cosine_strict(a: str | Column, b: str | Column) -> Column:
    """As cosine, but empty vectors and unlike sizes are an error."""
    wrong = (F.size(a) != F.size(b)) | (F.size(a) <= 0)
    return F.when(wrong, F.raise_error(F.lit("vectors are empty or of unlike sizes"))).otherwise(cosine(a, b))


def normalise(a: str | Column) -> Column:
    """Scaled to length 1; an empty or zero vector is an error."""
    norm = magnitude(a)
    scaled = F.transform(col(a), lambda x: x.cast("double") / norm)
    return F.when(norm > 0, scaled).otherwise(F.raise_error(F.lit("a zero or empty vector can't be normalised")).cast("array<double>"))
