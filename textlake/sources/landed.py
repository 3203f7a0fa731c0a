"""Landed fetch results: ``(url, status, body)`` tables.

HTTP fetching is outside the engine; fetchers land their responses as a
table and the engine reads that. The test ``pages`` table has no status
column, so :func:`landed_from_pages` derives one: a page cut off before its
closing ``</html>`` counts as a failed fetch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def landed_from_pages(pages: DataFrame) -> DataFrame:
    status = F.when(F.col("html").contains("</html>"), F.lit(200)).otherwise(F.lit(404))
    return pages.select("page_id", "url", status.alias("status"), F.col("html").alias("body"))


def gate(status: Column, body: Column) -> Column:
    """The body only for status 200, else NULL."""
    return F.when(status == 200, body)


def latest_landing(landed: DataFrame, key: str, newest: str = "landed_at") -> DataFrame:
    """One landing per key: a success before any failure, then the newest.

    A page fetched again after a failure is landed twice. ``newest`` is used
    where the table has it; remaining ties take the greater status and body.
    """
    by = [F.coalesce(F.col("status") == 200, F.lit(False)).alias("ok")]
    by += [F.col(newest)] if newest in landed.columns else []
    by += [F.col("status"), F.col("body")]
    return landed.groupBy(key).agg(F.max_by(F.struct("status", "body"), F.struct(*by)).alias("_l")) \
        .select(key, "_l.status", "_l.body")


def page_lang(html: Column) -> Column:
    v = F.regexp_extract(html, r'<html lang="([a-z]+)"', 1)
    return F.when(v != "", v)
