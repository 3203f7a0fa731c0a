"""Row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions.text import keyword_match, object_bytes
from textlake.operators.aggregates import high_water_marks
from textlake.params import BYTES_OVERHEAD, MAX_BYTES


def after_mark(df: DataFrame, key: str, mark: str | None) -> DataFrame:
    """Rows after a high-water mark (string compare).

    With no mark yet (first run) the start is included; the reference skipped
    its own start day (documented deviation).
    """
    if mark is None:
        return df
    return df.where(F.col(key) > F.lit(mark))


def drop_null(df: DataFrame, col: str) -> DataFrame:
    """C6 / C18."""
    return df.where(F.col(col).isNotNull())


def select_titles(df: DataFrame, keywords, full_extraction: bool, title: str = "title") -> DataFrame:
    """Full extraction keeps every row, else the keyword filter applies."""
    if full_extraction:
        return df
    return df.where(keyword_match(F.col(title), keywords))


def per_group_pending(items: DataFrame, done: DataFrame, group: list[str], number: str) -> DataFrame:
    """C11: items whose number is above the group's high-water mark.

    A mark covers numbers only: items without one stay.

    The mark table has one row per group (years x classes), so the join is
    small on one side and never ships the item table to every task.
    """
    marks = high_water_marks(done, group, number, "_hwm")
    return (items.join(marks, group, "left")
                 .where(F.col(number).isNull() | (F.col(number) > F.coalesce(F.col("_hwm"), F.lit(0))))
                 .drop("_hwm"))


def non_empty_text(df: DataFrame, text: str = "text") -> DataFrame:
    """C12 (NULL drops too)."""
    return df.where(F.length(text) > 0)


def under_bytes(df: DataFrame, max_bytes: int = MAX_BYTES, text: str = "text",
                overhead: int = BYTES_OVERHEAD) -> DataFrame:
    """Adds ``num_bytes`` (UTF-8 bytes + object overhead), keeps ``< max``.

    The reference returned None when the column was missing; here a missing
    column is an analysis error raised before any job runs.
    """
    return df.withColumn("num_bytes", object_bytes(F.col(text), overhead)) \
             .where(F.col("num_bytes") < F.lit(max_bytes))


def non_empty_link(df: DataFrame, col: str) -> DataFrame:
    """C19."""
    return df.where(F.col(col).isNotNull() & (F.col(col) != ""))
