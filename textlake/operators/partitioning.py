"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute an input that has fewer partitions than the cluster has
    cores, before CPU-heavy per-row work (Python chunking, encoding).

    A large input already has many more partitions than cores and is left
    as it is, so this never adds a shuffle of a big table; it only keeps a
    few-file input from running on a few cores.
    """
    if df.isStreaming:  # micro-batches are partitioned by the source
        return df
    # the optimizer's size estimate: nothing is executed to decide
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    target = df.sparkSession.sparkContext.defaultParallelism
    if size >= target * df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)


#: Estimates above this are defaults of inputs without statistics.
_UNKNOWN_BYTES = 1 << 50


def deal(df: DataFrame, key: str, source: DataFrame, part_bytes: int) -> DataFrame:
    """Hash partitions by ``key`` that stand for about ``part_bytes`` of ``source`` each, however large it is.

    The number follows the optimizer's size estimate of ``source``; without
    one it is the session's.
    """
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > _UNKNOWN_BYTES:
        return df.repartition(key)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes)), key)
