"""Join-shaped operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes we accept to ship to every executor when the number of rows is
# *proven* by the caller (e.g. queries x k hits) and their columns are of
# bounded width. Above it the optimizer's own size-checked choice (AQE
# broadcast threshold, else sort-merge) applies.
BROADCAST_BYTE_BOUND = 64 * 1024 * 1024
_VARIABLE = ("string", "binary", "array", "map", "struct")


def within_bound(df: DataFrame, rows_bound: int | None, text_bytes: int = 64) -> bool:
    """Whether :func:`bounded_broadcast` gives the hint.

    A row counts 16 bytes a fixed-width column and ``text_bytes`` a column of
    variable width (ids and terms; long texts need their own bound).
    """
    width = sum(text_bytes if t.startswith(_VARIABLE) else 16 for _, t in df.dtypes)
    return rows_bound is not None and rows_bound * width <= BROADCAST_BYTE_BOUND


def bounded_broadcast(df: DataFrame, rows_bound: int | None, text_bytes: int = 64) -> DataFrame:
    """Broadcast hint only behind a proven bound in bytes (:func:`within_bound`)."""
    return F.broadcast(df) if within_bound(df, rows_bound, text_bytes) else df


def not_yet_stored(candidates: DataFrame, stored: DataFrame, key: str,
                   stored_key: str | None = None) -> DataFrame:
    """Rows whose key is not in ``stored`` (NULL keys kept out)."""
    s = stored.select(F.col(stored_key or key).alias(key)).where(F.col(key).isNotNull())
    return candidates.where(F.col(key).isNotNull()).join(s, key, "left_anti")


def lookup(table: DataFrame, ids: DataFrame, key: str, id_key: str | None = None,
           ids_bound: int | None = None) -> DataFrame:
    """Rows of ``table`` whose key is listed; missing ids are absent."""
    i = ids.select(F.col(id_key or key).alias(key)).distinct()
    return table.join(bounded_broadcast(i, ids_bound), key, "left_semi")


def pair_with(hits: DataFrame, table: DataFrame, left_key: str, right_key: str,
              hits_bound: int | None = None) -> DataFrame:
    """Attach the text/metadata of each hit (hits are small: queries x k)."""
    return table.join(bounded_broadcast(hits, hits_bound),
                      F.col(right_key) == F.col(left_key), "inner")


def vector_record(df: DataFrame, key: str, vec: str, meta_cols: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """D9 + C16: ``(text_id, embedding, metadata map<string,string>)`` and the ``more`` columns.

    Metadata values are cast to string; NULL becomes '' (never 'nan').
    """
    kv = []
    for c in meta_cols:
        kv += [F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit(""))]
    return df.select(F.col(key).cast("string").alias("text_id"), F.col(vec).alias("embedding"),
                     F.create_map(*kv).alias("metadata"), *more)
