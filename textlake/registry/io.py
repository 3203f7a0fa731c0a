"""Source, sink and incremental queries.

These write to a fresh folder under the shared checkpoint directory and
read the result back, so the written layout itself is what is checked.
"""

import os

from pyspark.sql import functions as F

from textlake.functions import markup as M
from textlake.operators import joins as J
from textlake.operators import windows as W
from textlake.params import UPSERT_BATCH
from textlake.registry.base import register
from textlake.schemas import DOCUMENTS
from textlake.session import scratch_path
from textlake.sinks.tables import UpsertTable, append_new, read_marks, write_marks
from textlake.sources import files as FS
from textlake.sources.landed import page_lang
from textlake.streaming.incremental import assemble_deltas, deltas, next_cursor, next_window, rounds_left

FEED_MARK = "2024-01-15 00:00:00"


def _year(c):
    """Publication year assigned to a test document (partition column)."""
    return (F.lit(1978) + F.pmod(c, F.lit(47))).cast("int")


@register("src_csv_roundtrip", """
SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars_read, lang FROM documents
""")
def src_csv_roundtrip(t):
    """A1 / A3: corpus written as CSV files, listed, and read back in one scan."""
    spark = t.spark
    path = scratch_path(spark, "csv")
    FS.write_csv(t.documents, path)
    n_files = FS.list_files(spark, path, ".csv").count()
    if n_files == 0:
        raise RuntimeError("no csv files listed")
    back = FS.read_csv(spark, path, DOCUMENTS)
    return back.select("doc_id", F.md5("text").alias("text_md5"),
                       F.char_length("text").cast("long").alias("n_chars_read"), "lang")


@register("src_wholetext", """
SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY lang
""")
def src_wholetext(t):
    """A2: whole-file text reads; per language the files hold every text plus
    its line end."""
    spark = t.spark
    path = scratch_path(spark, "txt")
    t.documents.select("lang", "text").write.mode("overwrite").partitionBy("lang").text(path)
    files = FS.read_whole_text(spark, path)
    files = files.withColumn("lang", F.regexp_extract("file_path", "lang=([a-z]+)", 1))
    return files.groupBy("lang").agg(F.sum("n_chars").cast("long").alias("n_chars"))


@register("src_year_folders", """
SELECT CAST(1978 + doc_id % 47 AS INTEGER) AS year, count(*) AS n_docs,
       CAST(sum(n_chars) AS BIGINT) AS n_chars
FROM documents GROUP BY 1
""")
def src_year_folders(t):
    """Corpus written one folder per year, scanned back with the
    year taken from the folder."""
    spark = t.spark
    path = scratch_path(spark, "years")
    t.documents.withColumn("year", _year(F.col("doc_id"))) \
        .repartitionByRange("year", "doc_id").write.mode("overwrite").partitionBy("year").parquet(path)
    back = FS.read_year_folders(spark, path, prefix="year=")
    return back.groupBy(F.col("year").cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").cast("long").alias("n_chars"))


@register("sink_year_split_names", """
SELECT CAST(1978 + doc_id % 47 AS INTEGER) AS year, doc_id,
       printf('%d_%06d', CAST(1978 + doc_id % 47 AS INTEGER),
              row_number() OVER (PARTITION BY doc_id % 47 ORDER BY doc_id)) AS record_name
FROM documents
""")
def sink_year_split_names(t):
    """One record name ``{year}_{n:06}`` per document of a year."""
    d = t.documents.select("doc_id", _year(F.col("doc_id")).alias("year"))
    r = W.dense_row_number(d, ["year"], ["doc_id"], "n")
    return r.select("year", "doc_id", F.format_string("%d_%06d", "year", "n").alias("record_name"))


@register("src_table_exists", f"""
SELECT DISTINCT unnest(regexp_extract_all(html, 'a href="([^"]*)"', 1)) AS base_url FROM pages
""")
def src_table_exists(t):
    """Link table appended through the catalog (files in the shared
    folder), existence checked, one column read back."""
    spark = t.spark
    links = t.pages.select(F.explode(M.all_hrefs(F.col("html"))).alias("base_url")).distinct()
    path = scratch_path(spark, "linktable")
    name = "textlake_links_" + os.path.basename(path).replace("-", "_")
    # a catalog table whose files live in the shared folder (not the cwd)
    links.limit(0).write.mode("append").option("path", path).saveAsTable(name)
    links.write.mode("append").option("path", path).saveAsTable(name)
    col = FS.table_column(spark, name, "base_url")
    if col is None:
        raise RuntimeError("table missing")
    spark.sql(f"DROP TABLE {name}")  # external: its files stay for this result
    return col


@register("src_link_set", """
SELECT DISTINCT unnest(regexp_extract_all(html, 'a href="([^"]*)"', 1)) AS href FROM pages
""")
def src_link_set(t):
    """A stored link set (written twice: duplicates) loaded distinct."""
    spark = t.spark
    path = scratch_path(spark, "links")
    links = t.pages.select(F.explode(M.all_hrefs(F.col("html"))).alias("href"))
    links.write.mode("append").parquet(path)
    links.write.mode("append").parquet(path)
    return FS.read_link_set(spark, path)


@register("sink_append_once", """
SELECT event_id, event_type FROM events
""")
def sink_append_once(t):
    """B1 / J1 (batch): the feed appended by day in two overlapping batches
    (the first with every row twice) and one replay; every key lands once."""
    spark = t.spark
    path = scratch_path(spark, "append")
    e = t.events.select("event_id", "event_type", "ts", F.to_date("ts").cast("string").alias("day"))
    first = e.where(F.col("ts") <= F.lit(FEED_MARK).cast("timestamp_ntz"))
    append_new(first.unionAll(first), path, ["event_id"], ["day"])
    append_new(e, path, ["event_id"], ["day"])
    append_new(e, path, ["event_id"], ["day"])  # replay: no-op
    return spark.read.parquet(path).select("event_id", "event_type")


@register("sink_upsert_replay", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type,
       arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY user_id
""")
def sink_upsert_replay(t):
    """Upserts by key, the newer batch first and replayed after
    the older one; the table holds the newest row of every key."""
    spark = t.spark
    path = scratch_path(spark, "upsert")
    e = t.events.select("user_id", "event_type", "value", "ts", "event_id")
    mark = F.lit(FEED_MARK).cast("timestamp_ntz")
    tab = UpsertTable(spark, path, ["user_id"], order="order_key")
    keyed = e.withColumn("order_key", F.struct("ts", "event_id"))
    tab.write_batch(keyed.where(F.col("ts") > mark))
    tab.write_batch(keyed.where(F.col("ts") <= mark))
    tab.write_batch(keyed.where(F.col("ts") > mark))  # replay
    return tab.read().select("user_id", "event_type", "value")


@register("inc_resume_feed", f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_new
FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE ts <= TIMESTAMP '{FEED_MARK}')
GROUP BY 1
""")
def inc_resume_feed(t):
    """J1 / C3 / E8 (batch twin): mark from what landed, then only newer rows."""
    e = t.events
    landed = e.where(F.col("ts") <= F.lit(FEED_MARK).cast("timestamp_ntz"))
    mark = landed.select(F.max("event_id")).scalar()
    new = e.where(F.col("event_id") > mark)
    return new.groupBy(F.to_date("ts").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n_new"))


@register("inc_backward_cursor", """
WITH first AS (SELECT event_type, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'),
m1 AS (SELECT event_type, count(DISTINCT CAST(ts AS DATE)) - 1 AS round FROM first GROUP BY 1),
second AS (SELECT event_type, ts FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00')
SELECT s.event_type, strftime(min(CAST(s.ts AS DATE)), '%d/%m/%Y') AS date,
       CAST(coalesce(any_value(m1.round), -1) + count(DISTINCT CAST(s.ts AS DATE)) AS BIGINT) AS round,
       greatest(40 - (CAST(coalesce(any_value(m1.round), -1) + count(DISTINCT CAST(s.ts AS DATE)) AS BIGINT) + 1), 0) AS rounds_left,
       strftime(min(CAST(s.ts AS DATE)), '01/01/%Y') AS window_start, strftime(min(CAST(s.ts AS DATE)), '%d/%m/%Y') AS window_end
FROM second s LEFT JOIN m1 USING (event_type) GROUP BY s.event_type
""")
def inc_backward_cursor(t):
    """Two backward runs; the mark of the first run (written
    as a versioned table) is continued by the second; rounds left of 40 and
    the next search window."""
    spark = t.spark
    path = scratch_path(spark, "marks")
    e = t.events.select("event_type", F.to_date("ts").alias("d"), "ts")
    split = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    first = next_cursor(e.where(F.col("ts") > split), "event_type", F.col("d"))
    write_marks(first, path, 1)
    marks = read_marks(spark, path)
    second = next_cursor(e.where(F.col("ts") <= split), "event_type", F.col("d"), marks)
    return next_window(rounds_left(second, 40))


@register("inc_stream_deltas", """
SELECT conv_id, turn, count(*) AS n_deltas, string_agg(d, '' ORDER BY i) AS message
FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+[ \\t\\n\\r]*|[ \\t\\n\\r]+')) AS d,
             unnest(generate_series(1, len(regexp_extract_all(text, '[^ \\t\\n\\r]+[ \\t\\n\\r]*|[ \\t\\n\\r]+')))) AS i
      FROM conversations WHERE role = 'assistant')
WHERE length(d) > 0 GROUP BY conv_id, turn
""")
def inc_stream_deltas(t):
    """J4 / E15 (batch twin): assistant messages rebuilt from their deltas."""
    a = t.conversations.where(F.col("role") == "assistant")
    return assemble_deltas(deltas(a, "text", ["conv_id", "turn"]), ["conv_id", "turn"])


@register("sink_batch_labels", f"""
SELECT lang, doc_id, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) / {UPSERT_BATCH}) AS BIGINT) AS batch
FROM documents
""")
def sink_batch_labels(t):
    """Fixed-size write batches per language (skew-proof numbering)."""
    r = W.dense_row_number(t.documents.select("lang", "doc_id"), ["lang"], ["doc_id"], "row_no")
    return r.select("lang", "doc_id", W.batch_label(F.col("row_no"), UPSERT_BATCH).alias("batch"))


@register("join_fetch_by_lang_links", """
WITH l AS (SELECT DISTINCT NULLIF(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang,
                  unnest(regexp_extract_all(html, 'a href="([^"]*)"', 1)) AS href FROM pages)
SELECT lang, count(*) AS n_links FROM l GROUP BY lang
""")
def join_fetch_by_lang_links(t):
    """D3 (semi join) + E1: distinct links per page language."""
    links = t.pages.select(page_lang(F.col("html")).alias("lang"),
                           F.explode(M.all_hrefs(F.col("html"))).alias("href")).distinct()
    langs = t.pages.select(page_lang(F.col("html")).alias("lang")).distinct()
    return J.lookup(links, langs, "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("n_links"))
