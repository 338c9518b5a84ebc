"""Dense vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _a(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_a(a), _a(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def total(a: str | Column) -> Column:
    return F.aggregate(_a(a), F.lit(0.0), lambda s, v: s + v)


def softplus(a: str | Column) -> Column:
    """log(1 + e^x) + 1 of each element: evidence as Dirichlet parameters."""
    return F.transform(_a(a), lambda x: F.log1p(F.exp(x)) + 1)


def uncertainty(alpha: str | Column) -> Column:
    return F.size(_a(alpha)) / total(alpha)
