"""Queries over Python-backed operators (no SQL oracle; pytest checks them).

K1 / K2 recursive chunking, S18 / S19 tolerant markup parsing, K5 encoding
with upsert (P6), and the end-to-end benchmark retrieval (P4-P9).
"""

from pyspark.sql import functions as F

from textlake.functions.markup import extract_fields
from textlake.operators.embedding import encode
from textlake.params import SUMMARY_SEPARATORS, Params
from textlake.plans.corpus import chunk_corpus, encode_and_upsert, profile_chunks
from textlake.plans.retrieval import assemble, retrieve, with_context
from textlake.registry.base import register
from textlake.registry.relational import DOC_CHUNKS, doc_chunks
from textlake.registry.sqlparts import terms_sql, tokens
from textlake.session import scratch_path
from textlake.sinks.tables import UpsertTable


def _chunks(t, params=Params()):
    return chunk_corpus(t.documents, None, params, key="doc_id", meta=["doc_id", "lang", "source"])


@register("chunk_recursive")
def chunk_recursive(t):
    """Recursive chunks (1024 / 256) with metadata."""
    c = _chunks(t)
    return c.select("doc_id", "chunk_no", "text_id", "chunk_file", "lang",
                    F.char_length("chunk").cast("long").alias("n_chars"))


@register("chunk_recursive_paragraphs")
def chunk_recursive_paragraphs(t):
    """K2: paragraph / line separators only (a chunk may exceed the size)."""
    p = Params(separators=SUMMARY_SEPARATORS)
    c = _chunks(t, p)
    return c.select("doc_id", "chunk_no", F.char_length("chunk").cast("long").alias("n_chars"))


@register("profile_chunk_tokens")
def profile_chunk_tokens(t):
    """Statistics of all recursive chunks."""
    return profile_chunks(_chunks(t))["stats"]


@register("src_markup_fields")
def src_markup_fields(t):
    """One tolerant parse per page: title, h1, article text."""
    f = extract_fields(F.col("html"), fields=("title", "h1"), parent="body", child="article")
    p = t.pages.withColumn("_f", f)
    return p.select("page_id", F.col("_f.title").alias("title"), F.col("_f.h1").alias("h1"),
                    F.char_length("_f.body").cast("long").alias("body_chars"))


@register("vec_encode_upsert")
def vec_encode_upsert(t):
    """Chunks encoded and upserted twice
    (the replay is a no-op); the store statistics are returned."""
    spark = t.spark
    store = UpsertTable(spark, scratch_path(spark, "vectors"), ["text_id"])
    chunks = _chunks(t)
    encode_and_upsert(chunks, store, text="chunk", meta=["doc_id", "lang", "source"])
    return encode_and_upsert(chunks, store, text="chunk", meta=["doc_id", "lang", "source"])


@register("rag_benchmark_retrieval")
def rag_benchmark_retrieval(t):
    """Benchmark questions against the
    encoded chunk store with the default 0.5 threshold and 5,120 budget."""
    p = Params()
    spark = t.spark
    path = scratch_path(spark, "store")
    encode(_chunks(t), "chunk").select(
        F.col("text_id").alias("vec_id"), "chunk", "embedding", "model_id") \
        .write.mode("overwrite").parquet(path)
    store = spark.read.parquet(path)
    queries = encode(t.benchmark, "text").select(F.col("item_id").alias("query_id"), "embedding", "model_id")
    n_q = t.benchmark.count()
    hits = retrieve(queries, store, p, materialize=True)
    ctx = with_context(hits, store.select("vec_id", F.col("chunk").alias("text")), "vec_id", "text",
                       n_q, p.top_k)
    return assemble(ctx, p.token_budget)


WINDOW_PROFILE_BYTES = 1_200  # so that some word-window chunks are over it


@register("profile_window_chunks", f"""
WITH c AS (SELECT chunk, strlen(chunk) + 33 < {WINDOW_PROFILE_BYTES} AS small FROM {DOC_CHUNKS})
SELECT CAST(count_if(small) AS BIGINT) AS n_chunks, CAST(sum({tokens('chunk')}) FILTER (WHERE small) AS BIGINT) AS total_tokens,
       round(avg({tokens('chunk')}) FILTER (WHERE small), 6) AS mean_tokens, CAST(count_if(NOT small) AS BIGINT) AS n_over_bytes
FROM c
""")
def profile_window_chunks(t):
    """Profile of the word-window chunks, those over the byte cap counted apart."""
    stats = profile_chunks(doc_chunks(t), Params(max_bytes=WINDOW_PROFILE_BYTES))["stats"]
    return stats.withColumn("mean_tokens", F.round("mean_tokens", 6))


@register("vec_window_upsert", f"""
SELECT lang, count(*) AS n_vectors, CAST(768 AS BIGINT) AS min_dim, CAST(768 AS BIGINT) AS max_dim
FROM {DOC_CHUNKS} WHERE len({terms_sql('chunk')}) > 0 GROUP BY lang
""")
def vec_window_upsert(t):
    """Word-window chunks encoded and upserted twice, with write batches per
    language; vectors and dimensions of the store (wordless chunks have none)."""
    store = UpsertTable(t.spark, scratch_path(t.spark, "window-vectors"), ["text_id"])
    chunks = doc_chunks(t)
    encode_and_upsert(chunks, store, meta=["doc_id", "lang"], group="lang")
    encode_and_upsert(chunks, store, meta=["doc_id", "lang"], group="lang")
    v = store.read().where(F.size("embedding") > 0)
    return v.groupBy("lang").agg(F.count(F.lit(1)).alias("n_vectors"), F.min(F.size("embedding")).cast("long").alias("min_dim"),
                                 F.max(F.size("embedding")).cast("long").alias("max_dim"))


@register("src_markup_title", r"""
SELECT page_id, regexp_extract(html, '<title>([^<&]*)</title>', 1) AS title FROM pages
WHERE regexp_matches(html, '<title>[^<&]*</title>')
""")
def src_markup_title(t):
    """The tolerant parser's title equals the plain one wherever the title is closed and has no entity."""
    p = t.pages.where(F.col("html").rlike("<title>[^<&]*</title>"))
    f = extract_fields(F.col("html"), fields=("title",), parent="body", child="article")
    return p.select("page_id", F.coalesce(f["title"], F.lit("")).alias("title"))
