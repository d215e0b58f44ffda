"""Arithmetic on arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F



def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """A vector of length one; null for zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    powers = F.transform(a, lambda x: F.exp(x - top))
    total = _sum(powers)
    return F.transform(powers, lambda x: x / total)


def argmax(a: Column) -> Column:
    """Position, from 0, of the first greatest element; null for an empty or null array."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)) - 1)


def mean(a: Column) -> Column:
    return F.try_divide(_sum(F.transform(a, lambda x: x.cast("double"))), F.size(a))


def logit(a: Column, b: Column, scale: float = 100.0) -> Column:
    """Scaled cosine of two vectors, as two-tower models give it; null if either is zero."""
    return cosine(a, b) * scale


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """Mean, by dimension, of the vectors whose mask is set; the number of these counts as 1e-9 at least, so none give zeros."""
    kept = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double")))
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), F.size(vectors[0])), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    n = F.greatest(_sum(F.transform(mask, lambda m: m.cast("double"))), F.lit(1e-9))
    return F.transform(total, lambda x: x / n)
