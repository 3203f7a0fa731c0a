"""Set operations (H1-H3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*dfs: DataFrame) -> DataFrame:
    """H1: UNION ALL by column name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """H2: set difference (distinct rows of ``a`` absent from ``b``)."""
    return a.subtract(b)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    """Accumulated distinct set."""
    return union_all(*dfs).distinct()
