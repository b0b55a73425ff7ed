"""Vector expressions over ARRAY<FLOAT|DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column | str) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(_col(a), lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def affine_cosine(c: Column) -> Column:
    """From -1..1 to 0..1."""
    return (c + 1) / 2
