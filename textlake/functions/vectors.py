"""Vector column functions (S27, S28, S30): native higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; NULL for zero vectors or size mismatch."""
    den = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (den > 0), dot(a, b) / den)


def percent_score(score: Column) -> Column:
    """``int(100*score+10)`` followed by '%' (display value, kept as is)."""
    return F.concat((F.lit(100.0) * score + F.lit(10.0)).cast("int").cast("string"), F.lit("%"))
