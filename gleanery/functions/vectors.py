"""Arithmetic of vectors in array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is null or has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def constant(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def normalised(a: Column) -> Column:
    """The vector at unit length; one without length stays."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def hashed_words(words: Column, size: int = 64) -> Column:
    """A vector of how often words fall on each of ``size`` places, by their hash: a deterministic stand-in for a model's embedding."""
    at = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % size)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(at, lambda x: x == k)).cast("double"))
