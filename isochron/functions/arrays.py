"""Column expressions over arrays of doubles, evaluated where the row lies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row.

    A column that a lambda refers to is otherwise put into the lambda by the optimizer and
    computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def central(a: Column, m: Column, power: int) -> Column:
    """The population's central moment of a given power; m is the mean."""
    def term(x: Column) -> Column:
        out = x - m
        for _ in range(power - 1):
            out = out * (x - m)
        return out

    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + term(x)), F.size(a))


def rms(a: Column) -> Column:
    return F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x), F.size(a)))


def max_abs(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def zero_crossings(a: Column) -> Column:
    """Sum of absolute differences of neighbours' signs over twice the length."""
    later, sooner = F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(1))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))
    return F.try_divide(total(F.zip_with(later, sooner, lambda x, y: F.abs(F.signum(x) - F.signum(y)))), 2.0 * F.size(a))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + eps)


def trapezoid(y: Column, x: Column) -> Column:
    """Area under y over x; 0 for fewer than two points."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    dx = F.zip_with(F.slice(x, 2, n), F.slice(x, 1, n), lambda p, q: p - q)
    sy = F.zip_with(F.slice(y, 2, n), F.slice(y, 1, n), lambda p, q: (p + q) / 2.0)
    return total(F.zip_with(dx, sy, lambda p, q: p * q))


def doubles(name: str) -> Column:
    return F.transform(F.col(name), lambda x: x.cast("double"))
