"""Resumable runs on number ranges (C11, J2): what is done is a set, not a mark.

A run asks for the items outside the stored ranges and records those that
succeeded. Failures need no table of their own: their numbers are gaps, which
the next run sees again. Recording is a union, so runs in any order, repeated
or overlapping, leave the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from textlake.operators.ranges import BLOCK, merge_ranges, number_ranges, outside_ranges
from textlake.sinks.tables import next_version, read_marks, write_marks


def pending_items(items: DataFrame, state: str, group: list[str], number: str, block: int = BLOCK) -> DataFrame:
    """Items not recorded as done in ``state``; all of them before the first run."""
    ranges = read_marks(items.sparkSession, state)
    return items if ranges is None else outside_ranges(items, ranges, group, number, block)


def record_done(done: DataFrame, state: str, group: list[str], number: str, block: int = BLOCK) -> None:
    """Add the numbers of ``done`` to the ranges in ``state`` as their next version."""
    spark = done.sparkSession
    ranges, stored = number_ranges(done, group, number, block), read_marks(spark, state)
    if stored is not None:
        ranges = merge_ranges(ranges.unionByName(stored), group, block)
    write_marks(ranges, state, next_version(spark, state))
