"""Expressions on array<double> columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def section(v: Column, first: int, count: int) -> Column:
    """`count` elements from 1-based position `first`, as doubles."""
    return doubles(F.slice(v, first, count))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def square_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(square_distance(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean_vector(v: Column, dims: int) -> Column:
    """Aggregate expression: element-wise mean of fixed-width vectors (map-side combinable)."""
    return F.array(*[F.avg(v[i]) for i in range(dims)])
