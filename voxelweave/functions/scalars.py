"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to a model value inside the logarithm; a pixel counts only where the model is above minus this.
EPSILON = 1e-6


def errdiv(a: Column, b: Column) -> Column:
    """a / b, and 0 wherever that is not a finite number."""
    q = F.try_divide(a, b)
    bad = q.isNull() | F.isnan(q) | (F.abs(q) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(q)


def round_half_down(x: Column) -> Column:
    """Nearest integer, halves downwards: 0.5 -> 0, 1.5 -> 1, -0.5 -> -1."""
    return F.ceil(x - 0.5).cast("int")


def to_unbounded(w: Column) -> Column:
    """The free parameter x of a density w >= 0."""
    return F.sqrt((w + 1) * (w + 1) - 1)


def from_unbounded(x: Column) -> Column:
    return F.sqrt(x * x + 1) - 1


def slope_of_density(x: Column) -> Column:
    """Derivative of the density by its free parameter."""
    return x / F.sqrt(x * x + 1)


def times_vector(m: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    """A 3x3 matrix, given by rows, times a vector."""
    return [m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)]


def times_matrix(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """Product of two 3x3 matrices, given by rows."""
    return [sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)]


def matrix_columns(prefix: str = "m") -> list[Column]:
    return [F.col(f"{prefix}{i}{j}") for i in range(3) for j in range(3)]


def norm(v: Sequence[Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def bounded(expr: Column, name: str) -> Column:
    """``expr`` as a one-row generator: what follows reads its value, so the optimizer does not work it out again in every filter."""
    return F.inline(F.array(F.struct(expr.alias(name))))
