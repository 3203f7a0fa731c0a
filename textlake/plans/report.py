"""Progress report over an index (E1, E7, E11) in one aggregation pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.params import UPSERT_BATCH


def progress_report(index: DataFrame, group: Column, done: Column,
                    batch: int = UPSERT_BATCH) -> DataFrame:
    """Per group and overall: rows, processed rows, percent and write
    batches. One scan, partial aggregation per group, then a rollup row."""
    g = index.select(group.alias("grp"), done.alias("_done"))
    agg = g.rollup("grp").agg(F.count(F.lit(1)).alias("total"),
                              F.count_if("_done").alias("done"),
                              F.grouping("grp").alias("_all"))
    return agg.select(
        F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("grp")).alias("grp"),
        "total", "done",
        (F.lit(100.0) * F.col("done") / F.col("total")).alias("pct"),
        F.ceil(F.col("total") / F.lit(batch)).cast("long").alias("n_batches"))
