"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def unit(v: Column, length: Column | None = None) -> Column:
    """v / (|v| + 1e-9); a zero vector stays zero."""
    scale = (norm(v) if length is None else length) + F.lit(1e-9)
    return F.transform(v, lambda x: x.cast("double") / scale)
