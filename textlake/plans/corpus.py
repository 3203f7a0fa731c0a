"""Index, documents, corpus formatting, chunking, profiling, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions.dates import day_id, parse_day_id
from textlake.functions.markup import extract_fields
from textlake.functions.text import object_bytes, title_prefix
from textlake.functions.tokens import token_count
from textlake.operators import filters as C
from textlake.operators.aggregates import high_water_marks, histogram, vector_stats
from textlake.operators.chunking import chunk_file, explode_recursive
from textlake.operators.embedding import encode, hashing_model_id
from textlake.operators.joins import not_yet_stored, vector_record
from textlake.operators.partitioning import spread_small
from textlake.operators.windows import batch_label, dense_row_number, first_rows
from textlake.params import BYTES_OVERHEAD, Params
from textlake.sinks.tables import UpsertTable
from textlake.sources import gazette as G
from textlake.sources.landed import gate, latest_landing


ITEM_BLOCK = r"(?s)<item(?:\s[^>]*)?>.*?</item>"
ITEM = "titulo string, urlxml string"


def build_index(calendar: DataFrame, landed_days: DataFrame, params: Params = Params(),
                mark: str | None = None) -> DataFrame:
    """Items of the landed day pages for calendar days after the mark.

    ``calendar``: ``day date``; ``landed_days``: ``day_id, status, body``
    (a day landed more than once counts once). Items are ``<item>`` elements
    at any depth, with ``titulo`` / ``urlxml`` children.
    """
    days = calendar.select(day_id(F.col("day")).alias("day_id"))
    days = C.after_mark(days, "day_id", mark)
    pages = latest_landing(landed_days.join(days, "day_id", "left_semi"), "day_id") \
        .withColumn("body", gate(F.col("status"), F.col("body")))
    # each item goes through Spark's own XML parser (JVM-side): entities are
    # decoded, and a broken item gives NULL fields for that item only
    blocks = pages.select("day_id", F.explode(F.regexp_extract_all(F.col("body"), F.lit(ITEM_BLOCK), 0)).alias("_x"))
    items = blocks.select("day_id", F.from_xml(F.col("_x"), ITEM, {"mode": "PERMISSIVE"}).alias("it")).select(
        "day_id", F.col("it.titulo").alias("title"), F.col("it.urlxml").alias("url_xml"))
    items = G.class_filter(items, params.class_letters)
    return items.select("day_id", G.absolute_url(F.col("url_xml")).alias("url"), "title")


def build_documents(index: DataFrame, landed_docs: DataFrame, done: DataFrame | None,
                    params: Params = Params(), retry: DataFrame | None = None) -> DataFrame:
    """keyword/full selection, per (class, year) resume, one parse per document.

    ``done`` holds the numbers already stored, ``retry`` the urls of failed
    fetches: those come up again although a later number is stored. Urls
    without a gazette key have no number, so no mark covers them.
    """
    idx = C.drop_null(index, "title")
    idx = C.select_titles(idx, params.keywords, params.full_extraction)
    idx = idx.withColumn("doc_key", G.doc_key(F.col("url"))) \
             .withColumn("cls", F.regexp_extract("url", G.KEY_PATTERN, 1)) \
             .withColumn("year", F.substring("day_id", 1, 4)) \
             .withColumn("n", F.when(F.col("doc_key").isNotNull(), G.doc_number(F.col("url"))))
    if done is not None:
        pending = C.per_group_pending(idx, done, ["cls", "year"], "n")
        if retry is not None:
            again = idx.join(retry.select("url").distinct(), "url", "left_semi")
            pending = pending.unionByName(again).dropDuplicates(["day_id", "url"])
        idx = pending
    docs = idx.join(latest_landing(landed_docs, "url").select("url", gate(F.col("status"), F.col("body")).alias("body")),
                    "url", "left")
    f = extract_fields(F.col("body"))
    return docs.withColumn("_f", f).select(
        F.col("day_id").alias("id"), "doc_key", "url", "title", "year",
        F.col("_f.origen_legislativo").alias("legislative_origin"),
        F.col("_f.departamento").alias("department"), F.col("_f.rango").alias("rang"),
        F.col("_f.body").alias("text"))


def format_corpus(docs: DataFrame) -> DataFrame:
    """Parsed date, stable key, fixed column order, sorted by date."""
    out = docs.withColumn("date", parse_day_id(F.col("id")))
    cols = ["doc_key", "url", "title", "date", "legislative_origin", "department", "rang", "text"]
    return out.select(*cols).orderBy("date", "doc_key")


def chunk_corpus(docs: DataFrame, done: DataFrame | None = None, params: Params = Params(),
                 key: str = "doc_key", text: str = "text", meta: list[str] | None = None,
                 prefix_title: bool = False) -> DataFrame:
    """Non-empty texts not yet chunked -> recursive chunks with metadata."""
    d = C.non_empty_text(C.drop_null(docs, text), text)
    if done is not None:
        d = not_yet_stored(d, done, key)
    meta = meta if meta is not None else [c for c in d.columns if c != text]
    d = spread_small(d, key)
    chunks = explode_recursive(d, text, key, meta, params.chunk_size, params.chunk_overlap, params.separators)
    if prefix_title and "title" in meta:
        chunks = chunks.withColumn("chunk", title_prefix(F.col("title"), F.col("chunk")))
    return chunks.withColumn("chunk_file", chunk_file(F.col(key).cast("string"), F.col("chunk_no")))


def profile_chunks(chunks: DataFrame, params: Params = Params(), text: str = "chunk",
                   order: tuple[str, ...] = ("text_id",)) -> dict:
    """P5: byte filter and token counts; returns the profiled table and stats.

    All chunks are profiled; ``params.max_chunks`` cuts to the first chunks
    by ``order`` where a caller asks for it. Chunks of ``params.max_bytes``
    and more are left out of the token statistics and counted in
    ``n_over_bytes``. :func:`profile_histogram` bins the profiled table.
    """
    if params.max_chunks is not None:
        chunks = first_rows(chunks, list(order), params.max_chunks)
    size = object_bytes(F.col(text), BYTES_OVERHEAD)
    small = size < F.lit(params.max_bytes)
    tokens = F.when(small, token_count(F.col(text)))
    flagged = chunks.select(size.alias("num_bytes"), small.alias("_small"), tokens.alias("token_count"))
    stats = flagged.agg(F.count_if("_small").alias("n_chunks"), F.sum("token_count").alias("total_tokens"),
                        F.avg("token_count").alias("mean_tokens"), F.count_if(~F.col("_small")).alias("n_over_bytes"))
    prof = C.under_bytes(chunks, params.max_bytes, text, BYTES_OVERHEAD)
    return {"chunks": prof.withColumn("token_count", token_count(F.col(text))), "stats": stats}


def profile_histogram(profiled: DataFrame, params: Params = Params()) -> DataFrame:
    """E4 over the profiled chunks."""
    return histogram(profiled, "token_count", params.hist_bins)


def encode_and_upsert(chunks: DataFrame, store: UpsertTable, params: Params = Params(), text: str = "chunk",
                      meta: list[str] | None = None, group: str | None = None) -> DataFrame:
    """Encode, build vector records (metadata as strings), upsert.

    Physical batching is Arrow's. With ``group`` set, rows also get the
    reference's write-batch label (``params.upsert_batch`` rows per group,
    skew-proof row number).
    """
    meta = meta if meta is not None else [c for c in chunks.columns if c not in (text, "text_id")]
    if group:  # numbered before the vectors are there: the numbered rows are sorted and stored
        label = F.coalesce(F.col(group).cast("string"), F.lit("")) if group in meta + [text] else F.lit(None).cast("string")
        chunks = chunks.withColumn("_label", label).withColumn("_id", F.col("text_id").cast("string"))
        chunks = dense_row_number(chunks, ["_label"], ["_id"], "row_no").drop("_label", "_id")
    rec = vector_record(encode(chunks, text), "text_id", "embedding", meta + [text], ("row_no",) if group else ()) \
        .withColumn("model_id", F.lit(hashing_model_id()))
    if group:
        rec = rec.withColumn(group, F.col("metadata")[group]) \
            .withColumn("write_batch", batch_label(F.col("row_no"), params.upsert_batch)).drop("row_no")
    store.write_batch(rec)
    return vector_stats(store.read())


def fetch_outcomes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split extracted documents into successes and a retry table.

    A document whose fetch failed (NULL text) is kept in the retry table
    instead of being stored as a row of NULLs, and it never moves a mark.
    """
    ok = docs.where(F.col("text").isNotNull())
    retry = docs.where(F.col("text").isNull()).select("url", F.col("id").alias("day_id"), "doc_key")
    return ok, retry


def success_marks(ok: DataFrame) -> DataFrame:
    """Per (class, year) high-water mark over successful documents only."""
    parts = F.split(F.col("doc_key"), "-")
    done = ok.select(F.element_at(parts, 1).alias("cls"), F.element_at(parts, 2).alias("year"),
                     F.element_at(parts, 3).cast("long").alias("n"))
    return high_water_marks(done, ["cls", "year"], "n", "n")
