"""Date column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.params import SPANISH_MONTHS


def calendar(start: Column, end: Column, skip_sundays: bool = True) -> Column:
    """Every day from start to end, both inclusive (an array)."""
    days = F.sequence(start, end, F.expr("INTERVAL 1 DAY"))
    if skip_sundays:
        days = F.filter(days, lambda d: F.weekday(d) != 6)
    return days


def calendar_rows(df: DataFrame, start: str, end: str, skip_sundays: bool = True) -> DataFrame:
    """One row per day for each (start, end) row."""
    return df.select(F.explode(calendar(F.col(start), F.col(end), skip_sundays)).alias("day"))


def day_id(d: Column) -> Column:
    """``yyyyMMdd``."""
    return F.date_format(d, "yyyyMMdd")


def parse_day_id(s: Column) -> Column:
    """``yyyyMMdd`` to date; malformed gives NULL."""
    return F.try_to_date(s, "yyyyMMdd")


def spanish_long_date(s: Column) -> Column:
    """First ``DD de MES de YYYY`` in a text to ``DD/MM/YYYY``.

    An unknown month gives NULL (the reference printed 'None').
    """
    pat = r"(\d{2})\sde\s(\w+)\sde\s(\d{4})"
    months = F.create_map(*[x for m, n in SPANISH_MONTHS for x in (F.lit(m), F.lit(n))])
    mm = F.try_element_at(months, F.regexp_extract(s, pat, 2))
    dd = F.regexp_extract(s, pat, 1)
    yy = F.regexp_extract(s, pat, 3)
    return F.when((dd != "") & mm.isNotNull(), F.concat_ws("/", dd, mm, yy))


def spanish_long_format(d: Column) -> Column:
    """Inverse of :func:`spanish_long_date` (used to build fixtures from dates)."""
    names = F.array(*[F.lit(m) for m, _ in SPANISH_MONTHS])
    return F.concat(F.date_format(d, "dd"), F.lit(" de "), F.element_at(names, F.month(d)),
                    F.lit(" de "), F.date_format(d, "yyyy"))


def year_start(ddmmyyyy: Column) -> Column:
    """``01/01/YYYY`` from ``dd/mm/yyyy``."""
    return F.concat(F.lit("01/01/"), F.element_at(F.split(ddmmyyyy, "/"), -1))


def stamp(ts: Column) -> Column:
    """``%Y/%m/%d, %H:%M:%S``."""
    return F.date_format(ts, "yyyy/MM/dd, HH:mm:ss")


def hours_minutes(seconds: Column) -> tuple[Column, Column]:
    """Whole hours and remaining whole minutes."""
    return (F.floor(seconds / 3600).cast("long"),
            F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("long"))
