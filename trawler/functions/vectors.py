"""Column functions on ``array<float>`` vectors; products are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when widths differ or either vector is all zero."""
    length = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0)
    return F.when(usable, dot(a, b) / length).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """Unit-length copy; an all-zero vector stays as it is."""
    # The outer one-element transform binds the length, which is computed once.
    unit = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]
    return F.when(norm(a) > 0, unit).otherwise(a.cast("array<double>"))
