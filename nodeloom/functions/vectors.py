"""Arithmetic on array<double> columns of any length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def unit(a: Column) -> Column:
    """a divided by its length; null for the zero vector."""
    length = F.nullif(norm(a), F.lit(0.0))
    return F.transform(a, lambda x: x / length)


def angle_between(a: Column, b: Column) -> Column:
    """Radians; the cosine is clipped, so that parallel vectors give 0 or pi."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(unit(a), unit(b)))))
