"""Functions of numeric arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _pairs(a: Column, b: Column, f) -> Column:
    return F.zip_with(doubles(a), doubles(b), f)


def same_size(a: Column, b: Column) -> Column:
    """An error, as the row's value is used, if the sizes differ."""
    return F.assert_true(F.size(a) == F.size(b), F.lit("vectors of different sizes"))


def dot(a: Column, b: Column) -> Column:
    """Null if the sizes differ."""
    return F.when(F.size(a) == F.size(b), _sum(_pairs(a, b, lambda x, y: x * y)))


def magnitude(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0 or the sizes differ."""
    norms = magnitude(a) * magnitude(b)
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(_pairs(a, b, lambda x, y: (x - y) * (x - y)))))


def manhattan(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _sum(_pairs(a, b, lambda x, y: F.abs(x - y))))


def add(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x - y)


def scale(a: Column, factor: float) -> Column:
    return F.transform(doubles(a), lambda x: x * F.lit(float(factor)))


def unit(a: Column) -> Column:
    """The vector of length 1; a zero vector stays."""
    n = magnitude(a)
    return F.when(n > 0, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))
