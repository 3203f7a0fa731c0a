"""Window operators (F1-F7) and a skew-proof dense row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.session import materialize


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def budget_cut(df: DataFrame, group: str, order: list, tokens: str, limit: int) -> DataFrame:
    """keep the ordered prefix whose running token sum stays *below* limit.

    Counts are non-negative, so the running sum is monotone and "running sum
    < limit" equals "stop at the first overflow". Groups are per query (k
    rows each), never a data-sized partition.
    """
    w = Window.partitionBy(group).orderBy(*_cols(order)) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (df.withColumn("cum_tokens", F.sum(tokens).over(w))
              .where(F.col("cum_tokens") < F.lit(limit)))


def last_n(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """last ``n`` rows of each group (conversation memory)."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def dense_row_number(df: DataFrame, partition_cols: list[str], order_cols: list[str],
                     name: str = "row_no", num_partitions: int | None = None) -> DataFrame:
    """1-based row number within ``partition_cols`` ordered by ``order_cols``.

    A plain ``Window.partitionBy(year)`` sends a whole year to one task; when
    one year holds a third of the rows that task holds a third of the data.
    Here rows are range-partitioned on (partition, order) keys -- sampling
    splits a hot group over many tasks, whatever the number of groups --
    numbered inside each task, and shifted by the counts of earlier tasks of
    the same group (at most groups + tasks rows).

    Both branches must see the same ranges, and each exchange would sample
    its own, so the numbered rows are stored once in the checkpoint folder.
    NULL is a group like any other; columns outside the keys are carried.
    """
    keys = partition_cols + order_cols
    n = num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = df.repartitionByRange(int(n), *keys).sortWithinPartitions(*keys) \
        .withColumn("_mid", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("_pid", F.shiftright("_mid", 33)))
    starts = ranged.groupBy(*partition_cols, "_pid").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*partition_cols).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = starts.select(F.col("_pid").alias("_opid"), *[F.col(c).alias(f"_o_{c}") for c in partition_cols],
                            (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_pid") == F.col("_opid")
    for c in partition_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    out = ranged.join(offsets, same)
    return out.withColumn(name, F.col("_mid") + F.col("_shift") + 1).select(*df.columns, name)


def first_rows(df: DataFrame, order_cols: list[str], n: int) -> DataFrame:
    """The first ``n`` rows under a total order, however large ``n`` is.

    ``orderBy().limit(n)`` lets every partition send up to ``n`` rows to one
    task; here rows are numbered across range partitions and cut.
    """
    return dense_row_number(df, [], order_cols, "_row_no").where(F.col("_row_no") <= n).drop("_row_no")


def batch_label(row_no: Column, size: int) -> Column:
    """``floor((row_number - 1) / size)``."""
    return F.floor((row_no - F.lit(1)) / F.lit(size)).cast("long")


def last_by(value: Column, pos: Column) -> Column:
    """last element of an ordered list, as an aggregate."""
    return F.max_by(value, pos)
