"""Vectors as ``array<double>`` columns: products, norms, means."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest norm a cosine divides by.
EPS = 1e-8


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with norms clamped at ``EPS``; a zero vector gives 0."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def unit(v: Column) -> Column:
    """The vector over its norm; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(EPS))
    return F.transform(v, lambda x: x / n)


def minus_scalar(v: Column, s: Column) -> Column:
    return F.transform(v, lambda x: x - s)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scalar_mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v)


def mean_vector(v: Column, weight: Column | None = None) -> Column:
    """Aggregate: (weighted) mean of vectors of equal length. Partial sums of one row a group cross the shuffle, not
    exploded components."""
    x = array_to_vector(as_double(v))
    return vector_to_array(Summarizer.mean(x) if weight is None else Summarizer.mean(x, weight))
