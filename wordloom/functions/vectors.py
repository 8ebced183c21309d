"""Arithmetic on array<double> columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its norm; null for a zero vector. The norm is repeated, not part of the lambda, which would compute it for each entry."""
    return F.when(norm(a) > 0, F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, n: F.try_divide(x, n)))


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def pair_weight(val: Column, x_max: float, alpha: float) -> Column:
    """min(1, (val / x_max) ^ alpha)"""
    return F.when(val > x_max, F.lit(1.0)).otherwise(F.pow(val / x_max, F.lit(alpha)))


def clipped(x: Column, most: float) -> Column:
    return F.greatest(F.least(x, F.lit(most)), F.lit(-most))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))
