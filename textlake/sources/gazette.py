"""Gazette day index and document keys.

The reference reads a day index (``day_id, url, title``) from the gazette's
XML. Test tables carry no such feed, so :func:`day_index_from_orders`
derives one with Spark from ``orders`` (one item per order, so the index
grows with the table): class letter from the order status, year and number
from the order date and key, and a NULL title for the lowest priority.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.params import CLASS_CHAR_INDEX, GAZETTE_ROOT

ITEM_PATH = "/diario_boe/xml.php?id=BOE-"
KEY_PATTERN = r"BOE-([A-Z])-(\d{4})-(\d+)"


def day_index_from_orders(orders: DataFrame) -> DataFrame:
    cls = (F.when(F.col("o_orderstatus") == "F", "A")
            .when(F.col("o_orderstatus") == "O", "C").otherwise("B"))
    url_xml = F.concat(F.lit(ITEM_PATH), cls, F.lit("-"),
                       F.year("o_orderdate").cast("string"), F.lit("-"),
                       F.col("o_orderkey").cast("string"))
    title = F.when(F.col("o_orderpriority").startswith("5"), F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("Orden "), F.col("o_orderpriority"), F.lit(" del cliente "),
                            F.col("o_custkey").cast("string")))
    return orders.select(F.date_format("o_orderdate", "yyyyMMdd").alias("day_id"),
                         url_xml.alias("url_xml"), title.alias("title"))


def class_letter(url_xml: Column, index: int = CLASS_CHAR_INDEX) -> Column:
    """C4: character ``index`` (0-based); a short url gives '' (row-level)."""
    return F.substring(url_xml, index + 1, 1)


def class_filter(df: DataFrame, letters, url_col: str = "url_xml") -> DataFrame:
    """C4: keep items whose class letter is listed; NULL url drops the row only."""
    return df.where(F.col(url_col).isNotNull() & class_letter(F.col(url_col)).isin(list(letters)))


def absolute_url(path: Column, root: str = GAZETTE_ROOT) -> Column:
    """C5."""
    return F.concat(F.lit(root), path)


def doc_number(url: Column) -> Column:
    """Number after the last '-', as int (NULL when not numeric)."""
    return F.element_at(F.split(url, "-"), -1).try_cast("long")


def doc_key(url: Column) -> Column:
    """``class-year-number`` (unique, unlike the day id); NULL if no match."""
    c = F.regexp_extract(url, KEY_PATTERN, 1)
    y = F.regexp_extract(url, KEY_PATTERN, 2)
    n = F.regexp_extract(url, KEY_PATTERN, 3)
    return F.when(n != "", F.concat_ws("-", c, y, n))


def year_of_day(day_id: Column) -> Column:
    """Year prefix of a ``yyyyMMdd`` id."""
    return F.substring(day_id, 1, 4)
