"""Done-sets as number ranges instead of a single mark per group.

A mark says that everything up to a number is done, so a number that failed
below it needs a list of its own. Here the done numbers of a group are a set,
stored as its maximal runs (group, lo, hi): a gap in the middle stays visible,
and merging is a union, so runs may come in any order or twice.

Numbers are cut into blocks of ``BLOCK``; ranges meet and numbers are looked up
within (group, block), at most ``BLOCK`` rows a window, so a group that holds
most rows is spread over its blocks. Only runs that touch a block's edge, two a
block at most, are joined along the group. NULL is a group like any other;
rows without a number are in no range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _block(c: str, block: int):
    return F.floor(F.col(c) / F.lit(block))


def _in_blocks(ranges: DataFrame, group: list[str], block: int) -> DataFrame:
    """The ranges cut at the edges of blocks: (group, block, lo, hi), one row per (group, lo)."""
    cut = ranges.where("lo <= hi").select(*group, "lo", "hi", F.explode(F.sequence(_block("lo", block), _block("hi", block))).alias("_block"))
    first = F.col("_block") * block
    cut = cut.select(*group, "_block", F.greatest("lo", first).alias("lo"), F.least("hi", first + (block - 1)).alias("hi"))
    return cut.groupBy(*group, "_block", "lo").agg(F.max("hi").alias("hi"))


def _joined(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Ranges of equal ``by`` that overlap or follow each other become one."""
    order = Window.partitionBy(*by).orderBy("lo")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = ranges.withColumn("_first", F.coalesce((F.col("lo") > before + 1).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def merge_ranges(ranges: DataFrame, group: list[str], block: int = BLOCK) -> DataFrame:
    """Maximal runs (group, lo, hi) of the union of ``ranges``, which may overlap and repeat.

    ``lo`` and ``hi`` are whole numbers; ranges with a NULL end or ``lo > hi`` hold nothing.
    """
    within = _joined(_in_blocks(ranges, group, block), [*group, "_block"])
    first = F.col("_block") * block
    edge = (F.col("lo") == first) | (F.col("hi") == first + (block - 1))
    at_edge = _joined(within.where(edge).select(*group, "lo", "hi"), group)
    return within.where(~edge).select(*group, "lo", "hi").unionByName(at_edge)


def number_ranges(done: DataFrame, group: list[str], number: str, block: int = BLOCK) -> DataFrame:
    """Runs of the numbers of ``done``; repeated rows count once, rows without a number not at all."""
    n = F.col(number).cast("long")
    return merge_ranges(done.select(*group, n.alias("lo"), n.alias("hi")), group, block)


def outside_ranges(items: DataFrame, ranges: DataFrame, group: list[str], number: str, block: int = BLOCK) -> DataFrame:
    """Rows of ``items`` whose number lies in no range of their group; rows without a number stay."""
    n = F.col(number).cast("long")
    asked = items.where(n.isNotNull()).select(*group, n.alias("lo")).distinct()
    asked = asked.withColumns({"_block": _block("lo", block), "hi": F.lit(None).cast("long")})
    # in the order of numbers a range comes before a number equal to its start
    order = Window.partitionBy(*group, "_block").orderBy("lo", F.col("hi").asc_nulls_last())
    both = asked.unionByName(_in_blocks(ranges, group, block))
    covered = F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, 0)) >= F.col("lo"), F.lit(False))
    todo = both.withColumn("_in", covered).where("hi IS NULL AND NOT _in")
    todo = todo.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("lo").alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group], n == F.col("_n"))
    return items.where(n.isNull()).unionByName(items.join(todo, same, "left_semi"))
