"""Filters, joins, aggregates, windows, sorts and set queries (C, D, E, F, G, H)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textlake.functions import dates as D
from textlake.functions import markup as M
from textlake.functions import text as X
from textlake.functions.tokens import token_count
from textlake.operators import aggregates as A
from textlake.operators import filters as C
from textlake.operators import joins as J
from textlake.operators import setops as H
from textlake.operators import windows as W
from textlake.operators.chunking import chunk_file, explode_chunks, with_word_windows
from textlake.params import GAZETTE_ROOT, MAX_BYTES, UPSERT_BATCH
from textlake.registry.base import register
from textlake.registry.sqlparts import GAZETTE_INDEX, tokens
from textlake.sources import gazette as G
from textlake.sources.landed import gate, landed_from_pages, page_lang

# Keywords chosen so the filter returns rows on the synthetic corpus.
KEYWORDS = ("Élle", "ÜBER")
RESUME_MARK = "19950615"      # a day id inside the orders date range
DONE_UNTIL = "19960101"       # index rows up to this day count as extracted
WINDOW_WORDS = 200            # K3 word window used by the word-chunk queries
BUDGET = 300                  # conversation budget in tokens (F2 query)

IDX = f"({GAZETTE_INDEX})"
IDX_N = (f"(SELECT *, CAST(string_split(url_xml, '-')[-1] AS BIGINT) AS n, "
         f"substr(url_xml, 28, 1) AS cls, substr(day_id, 1, 4) AS year FROM {IDX})")
WORDS = "regexp_extract_all(text, '[^" + X.PY_WHITESPACE + "]+')"
WINDOWS_SQL = (f"list_transform(range(0, CAST(ceil(len({WORDS}) / {WINDOW_WORDS}) AS BIGINT)), "
               f"lambda i: array_to_string({WORDS}[i * {WINDOW_WORDS} + 1 : i * {WINDOW_WORDS} + "
               f"{WINDOW_WORDS}], ' '))")
DOC_CHUNKS = (f"(SELECT doc_id, lang, source, CAST(unnest(generate_series(1, len(w))) AS INTEGER) AS chunk_no, "
              f"unnest(w) AS chunk FROM (SELECT doc_id, lang, source, {WINDOWS_SQL} AS w "
              f"FROM documents))")
PAGE_LANG = "NULLIF(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '')"
HREFS = "regexp_extract_all(html, 'a href=\"([^\"]*)\"', 1)"


def _index(t):
    idx = G.day_index_from_orders(t.orders)
    return idx.withColumn("n", G.doc_number(F.col("url_xml"))) \
              .withColumn("cls", G.class_letter(F.col("url_xml"))) \
              .withColumn("year", G.year_of_day(F.col("day_id")))


def doc_chunks(t):
    d = with_word_windows(t.documents, "text", WINDOW_WORDS)
    return explode_chunks(d, F.col("windows"), "doc_id", ["doc_id", "lang", "source"])


# ---------------------------------------------------------------- filters

@register("flt_calendar", """
SELECT CAST(d AS DATE)::VARCHAR AS day, strftime(d, '%Y%m%d') AS day_id
FROM (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS d
      FROM events)
WHERE isodow(d) <> 7
""")
def flt_calendar(t):
    """Every day of the events' span without Sundays, with its day id."""
    span = t.events.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    days = D.calendar_rows(span, "a", "b")
    return days.select(F.col("day").cast("string").alias("day"), D.day_id(F.col("day")).alias("day_id"))


@register("flt_resume_after_mark", f"SELECT day_id, url_xml FROM {IDX} WHERE day_id > '{RESUME_MARK}'")
def flt_resume_after_mark(t):
    """Index rows strictly after the high-water mark."""
    return C.after_mark(G.day_index_from_orders(t.orders), "day_id", RESUME_MARK) \
        .select("day_id", "url_xml")


@register("flt_class_letter", f"""
SELECT url_xml FROM {IDX} WHERE url_xml IS NOT NULL AND substr(url_xml, 28, 1) IN ('A', 'C')
""")
def flt_class_letter(t):
    """C4: class letter at 0-based position 27 in A or C."""
    return G.class_filter(G.day_index_from_orders(t.orders), ("A", "C")).select("url_xml")


@register("flt_absolute_url_title", f"""
SELECT day_id, '{GAZETTE_ROOT}' || url_xml AS url, title FROM {IDX} WHERE title IS NOT NULL
""")
def flt_absolute_url_title(t):
    """Absolute url; rows with a NULL title dropped."""
    idx = C.drop_null(G.day_index_from_orders(t.orders), "title")
    return idx.select("day_id", G.absolute_url(F.col("url_xml")).alias("url"), "title")


@register("flt_year_prefix", f"""
SELECT day_id, url_xml FROM {IDX} WHERE starts_with(day_id, '1995')
""")
def flt_year_prefix(t):
    """Rows of one year by day-id prefix (a partition column when written)."""
    idx = G.day_index_from_orders(t.orders)
    return idx.where(G.year_of_day(F.col("day_id")) == "1995").select("day_id", "url_xml")


@register("flt_resume_per_group", f"""
WITH idx AS {IDX_N},
marks AS (SELECT cls, year, max(n) AS hwm FROM idx WHERE day_id <= '{DONE_UNTIL}' GROUP BY cls, year)
SELECT i.cls, i.year, i.n FROM idx i LEFT JOIN marks m ON i.cls = m.cls AND i.year = m.year
WHERE i.n > coalesce(m.hwm, 0)
""")
def flt_resume_per_group(t):
    """Per (class, year) mark; keep numbers above it."""
    idx = _index(t)
    done = idx.where(F.col("day_id") <= DONE_UNTIL)
    return C.per_group_pending(idx, done, ["cls", "year"], "n").select("cls", "year", "n")


@register("flt_keywords", r"""
SELECT doc_id FROM documents
WHERE contains(lower(regexp_replace(strip_accents(split_part(text, chr(10), 1)), '[^\x00-\x7F]', '', 'g')), 'elle')
   OR contains(lower(regexp_replace(strip_accents(split_part(text, chr(10), 1)), '[^\x00-\x7F]', '', 'g')), 'uber')
""")
def flt_keywords(t):
    """Accent- and case-insensitive keyword OR on the title line."""
    d = t.documents.withColumn("title", X.first_line(F.col("text")))
    return C.select_titles(d, KEYWORDS, full_extraction=False).select("doc_id")


@register("flt_extraction_switch", r"""
SELECT 'full' AS mode, count(*) AS n FROM documents
UNION ALL
SELECT 'partial', count(*) FROM documents
WHERE contains(lower(regexp_replace(strip_accents(split_part(text, chr(10), 1)), '[^\x00-\x7F]', '', 'g')), 'elle')
   OR contains(lower(regexp_replace(strip_accents(split_part(text, chr(10), 1)), '[^\x00-\x7F]', '', 'g')), 'uber')
""")
def flt_extraction_switch(t):
    """Full extraction vs keyword extraction."""
    hit = X.keyword_match(X.first_line(F.col("text")), KEYWORDS)
    n = t.documents.agg(F.count(F.lit(1)).alias("full"), F.count_if(hit).alias("partial"))  # one scan
    return n.unpivot([], ["full", "partial"], "mode", "n")


@register("flt_text_checks", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CAST(strlen(line) + 33 AS BIGINT) AS num_bytes FROM l
WHERE nullif(line, 'x') IS NOT NULL AND length(line) > 0 AND strlen(line) + 33 < 400
""")
def flt_text_checks(t):
    """Non-NULL, non-empty, and under a byte cap -- on the lines of all
    documents, which are of all three kinds (empty, long, short)."""
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("text"))
    d = C.non_empty_text(C.drop_null(lines.withColumn("text", F.nullif("text", F.lit("x"))), "text"))
    return C.under_bytes(d, 400).select("doc_id", "num_bytes")


@register("flt_text_checks_docs", f"""
SELECT doc_id, CAST(strlen(text) + 33 AS BIGINT) AS num_bytes FROM documents
WHERE text IS NOT NULL AND length(text) > 0 AND strlen(text) + 33 < {MAX_BYTES}
""")
def flt_text_checks_docs(t):
    """Non-NULL, non-empty documents under the reference's byte cap."""
    d = C.non_empty_text(C.drop_null(t.documents, "text"))
    return C.under_bytes(d, MAX_BYTES).select("doc_id", "num_bytes")


@register("fn_title_prefix", """
SELECT doc_id, CASE WHEN nullif(split_part(text, chr(10), 1), '') IS NULL THEN text
                    ELSE split_part(text, chr(10), 1) || ': ' || text END AS prefixed
FROM documents
""")
def fn_title_prefix(t):
    """C20: ``{title}: {text}`` with no prefix when the title is missing."""
    d = t.documents.withColumn("title", F.nullif(X.first_line(F.col("text")), F.lit("")))
    return d.select("doc_id", X.title_prefix(F.col("title"), F.col("text")).alias("prefixed"))


@register("fn_cast_string", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS VARCHAR) AS date,
       CAST(o_custkey AS VARCHAR) AS customer FROM orders
""")
def fn_cast_string(t):
    """Cast metadata to string (NULL stays NULL)."""
    o = t.orders
    return o.select(o.o_orderkey.cast("string").alias("id"), o.o_orderdate.cast("string").alias("date"),
                    o.o_custkey.cast("string").alias("customer"))


@register("src_response_gate", """
SELECT page_id, CASE WHEN contains(html, '</html>') THEN 200 ELSE 404 END AS status,
       CASE WHEN contains(html, '</html>') THEN md5(html) END AS body_md5
FROM pages
""")
def src_response_gate(t):
    """Body kept only for status 200."""
    land = landed_from_pages(t.pages)
    return land.select("page_id", "status", F.md5(gate(F.col("status"), F.col("body"))).alias("body_md5"))


@register("flt_nonempty_links", f"""
SELECT page_id, h AS href FROM (SELECT page_id, nullif(replace(unnest({HREFS}), '/the', ''), '/of') AS h FROM pages)
WHERE h IS NOT NULL AND h <> '' AND h <> '/'
""")
def flt_nonempty_links(t):
    """Links that resolved to nothing are dropped (``/the`` stands for an empty link, ``/of`` for a missing one)."""
    href = F.nullif(F.replace(F.col("href"), F.lit("/the"), F.lit("")), F.lit("/of"))
    links = t.pages.select("page_id", F.explode(M.all_hrefs(F.col("html"))).alias("href")).withColumn("href", href)
    return C.non_empty_link(links, "href").where(F.col("href") != "/")


# ---------------------------------------------------------------- joins

@register("join_anti_links", f"""
WITH l AS (SELECT DISTINCT {PAGE_LANG} AS lang, unnest({HREFS}) AS href FROM pages)
SELECT DISTINCT href FROM l WHERE lang IS DISTINCT FROM 'en' AND href IS NOT NULL
  AND href NOT IN (SELECT href FROM l WHERE lang = 'en' AND href IS NOT NULL)
""")
def join_anti_links(t):
    """Links of non-English pages not already stored from English pages."""
    links = t.pages.select(page_lang(F.col("html")).alias("lang"),
                           F.explode(M.all_hrefs(F.col("html"))).alias("href"))
    stored = links.where(F.col("lang") == "en").select("href")
    cand = links.where(~F.col("lang").eqNullSafe("en")).select("href").distinct()
    return J.not_yet_stored(cand, stored, "href")


@register("join_anti_done_docs", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
""")
def join_anti_done_docs(t):
    """Documents not yet processed (``labels`` stands for done)."""
    return J.not_yet_stored(t.documents.select("doc_id"), t.labels, "doc_id")


@register("join_semi_lookup", """
SELECT vec_id, label, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings
WHERE vec_id IN (SELECT doc_id FROM labels)
""")
def join_semi_lookup(t):
    """Fetch vectors by a list of ids; missing ids are simply absent."""
    v = J.lookup(t.embeddings, t.labels, "vec_id", id_key="doc_id")
    return v.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


@register("join_doc_chunks", f"""
SELECT doc_id, lang, source, chunk_no, CAST(doc_id AS VARCHAR) || '_chunk' || chunk_no AS text_id,
       printf('%s_%04d', CAST(doc_id AS VARCHAR), chunk_no) AS chunk_file, chunk
FROM {DOC_CHUNKS}
""")
def joindoc_chunks(t):
    """Word-window chunks with copied metadata."""
    c = doc_chunks(t)
    return c.select("doc_id", "lang", "source", "chunk_no", "text_id",
                    chunk_file(F.col("doc_id").cast("string"), F.col("chunk_no")).alias("chunk_file"),
                    "chunk")


@register("join_vector_record", """
SELECT CAST(e.vec_id AS VARCHAR) AS text_id, coalesce(d.lang, '') AS lang,
       coalesce(d.source, '') AS source, '' AS missing, CAST(len(e.embedding) AS BIGINT) AS dim
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
""")
def join_vector_record(t):
    """``(text_id, embedding, metadata)``; absent keys read as ''."""
    e = t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id"), "lang", "source"),
                          "vec_id", "left")
    rec = J.vector_record(e, "vec_id", "embedding", ["lang", "source"])
    md = F.col("metadata")
    return rec.select("text_id", F.coalesce(md["lang"], F.lit("")).alias("lang"),
                      F.coalesce(md["source"], F.lit("")).alias("source"),
                      F.coalesce(md["missing"], F.lit("")).alias("missing"),
                      F.size("embedding").cast("long").alias("dim"))


# ---------------------------------------------------------------- aggregates

@register("agg_stage_counts", f"""
SELECT count(*) AS n_rows, CAST(count_if(text IS NOT NULL) AS BIGINT) AS n_not_null,
       CAST(count_if(length(text) > 0) AS BIGINT) AS n_non_empty,
       CAST(count_if(strlen(text) + 33 < {MAX_BYTES}) AS BIGINT) AS n_under_bytes
FROM documents
""")
def agg_stage_counts(t):
    """Stage counts in one scan."""
    d = t.documents
    return A.stage_counts(d, not_null=F.col("text").isNotNull(),
                          non_empty=F.length("text") > 0,
                          under_bytes=(F.octet_length("text") + 33) < MAX_BYTES)


@register("agg_tokens_by_lang", f"""
SELECT lang, CAST(sum({tokens('text')}) AS BIGINT) AS total_tokens,
       round(avg({tokens('text')}), 6) AS mean_tokens, count(*) AS n_docs
FROM documents GROUP BY lang
""")
def agg_tokens_by_lang(t):
    """Total and mean token counts per language."""
    d = t.documents.withColumn("tok", token_count(F.col("text")))
    return d.groupBy("lang").agg(F.sum("tok").cast("long").alias("total_tokens"),
                                 F.round(F.avg("tok"), 6).alias("mean_tokens"),
                                 F.count(F.lit(1)).alias("n_docs"))


@register("agg_token_histogram", f"""
WITH x AS (SELECT {tokens('text')} AS v FROM documents),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM x)
SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) * 20 / (hi - lo)), 19) END AS BIGINT) AS bin,
       count(*) AS n
FROM x, b GROUP BY 1
""")
def agg_token_histogram(t):
    """20 equal-width bins of document token counts."""
    x = t.documents.select(token_count(F.col("text")).alias("v"))
    return A.histogram(x, "v", 20)


@register("agg_distinct_ids", "SELECT DISTINCT doc_id FROM labels")
def agg_distinct_ids(t):
    """E5: distinct ids."""
    return t.labels.select("doc_id").distinct()


@register("agg_progress", f"""
SELECT substr(day_id, 1, 4) AS year, CAST(count_if(day_id <= '{DONE_UNTIL}') AS BIGINT) AS done, count(*) AS total,
       100.0::DOUBLE * count_if(day_id <= '{DONE_UNTIL}') / count(*) AS pct
FROM {IDX} GROUP BY 1
UNION ALL
SELECT 'all', CAST(count_if(day_id <= '{DONE_UNTIL}') AS BIGINT), count(*),
       100.0::DOUBLE * count_if(day_id <= '{DONE_UNTIL}') / count(*) FROM {IDX}
""")
def agg_progress(t):
    """Percent processed per year and overall."""
    idx = G.day_index_from_orders(t.orders).withColumn("year", G.year_of_day(F.col("day_id")))
    done = F.col("day_id") <= DONE_UNTIL
    # counts per year in one scan; the total sums those few rows
    years = A.percent_done(idx, ["year"], done)
    both = years.select(F.explode(F.array("year", F.lit("all"))).alias("year"), "done", "total")
    return both.groupBy("year").agg(F.sum("done").alias("done"), F.sum("total").alias("total")) \
        .withColumn("pct", F.lit(100.0) * F.col("done") / F.col("total"))


@register("agg_high_water_marks", """
SELECT event_type, max(event_id) AS hwm, CAST(max(ts) AS VARCHAR) AS last_ts FROM events GROUP BY 1
""")
def agg_high_water_marks(t):
    """One mark per source (the maximum, not the last row read)."""
    e = t.events.select("event_type", F.struct("event_id").alias("_id"), "event_id", "ts")
    last = A.high_water_marks(e, ["event_type"], "ts", "last_ts")
    return A.high_water_marks(e, ["event_type"], "event_id").join(last, "event_type") \
        .select("event_type", "hwm", F.col("last_ts").cast("string").alias("last_ts"))


@register("agg_outcomes", """
SELECT regexp_extract(url, '^(https?)', 1) AS scheme,
       CAST(count_if(contains(html, '</html>')) AS BIGINT) AS n_success,
       CAST(count_if(NOT contains(html, '</html>')) AS BIGINT) AS n_fails
FROM pages GROUP BY 1
""")
def agg_outcomes(t):
    """Success / failure counters of landed fetches."""
    land = landed_from_pages(t.pages).withColumn("scheme", F.regexp_extract("url", "^(https?)", 1))
    return A.outcome_counts(land, ["scheme"], F.col("status") == 200)


@register("agg_index_stats", """
SELECT count(*) AS n_vectors, CAST(min(len(embedding)) AS BIGINT) AS min_dim,
       CAST(max(len(embedding)) AS BIGINT) AS max_dim FROM embeddings
""")
def agg_index_stats(t):
    """Vector count and dimension."""
    return A.vector_stats(t.embeddings)


@register("agg_batch_counts", f"""
SELECT substr(day_id, 1, 4) AS year, count(*) AS n, CAST(ceil(count(*) / {UPSERT_BATCH}) AS BIGINT) AS n_batches,
       (SELECT count(DISTINCT substr(day_id, 1, 4)) FROM {IDX}) AS n_years
FROM {IDX} GROUP BY 1
""")
def agg_batch_counts(t):
    """Folder (year) count and write batches per year."""
    idx = G.day_index_from_orders(t.orders).withColumn("year", G.year_of_day(F.col("day_id")))
    years = idx.groupBy("year").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("n_batches", F.ceil(F.col("n") / UPSERT_BATCH).cast("long"))
    # one row per year is left: counting those rows needs no second scan
    return years.withColumn("n_years", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))


@register("agg_rate_runtime", """
SELECT user_id, round(sum(value) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS per_second,
       CAST(floor(((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000) / 3600) AS BIGINT) AS hours,
       CAST(floor((((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000) % 3600) / 60) AS BIGINT) AS minutes
FROM events GROUP BY user_id
""")
def agg_rate_runtime(t):
    """Amount per second (NULL when no time elapsed), whole h and min."""
    e = t.events.groupBy("user_id").agg(
        F.sum("value").alias("total"),
        F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")).alias("us"))
    secs = F.floor(F.col("us") / 1_000_000)
    h, m = D.hours_minutes(secs)
    rate = A.per_second(F.col("total"), F.col("us") / F.lit(1e6))
    return e.select("user_id", F.round(F.when(F.col("us") > 0, rate), 6).alias("per_second"),
                    h.alias("hours"), m.alias("minutes"))


@register("agg_ordered_turns", """
SELECT conv_id, count(*) AS n_turns,
       string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id
""")
def agg_ordered_turns(t):
    """Ordered assembly of a conversation."""
    c = t.conversations
    return c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        A.ordered_join(F.col("turn"), F.concat_ws(": ", "role", "text"), "\n\n").alias("transcript"))


# ---------------------------------------------------------------- windows

@register("win_budget_cut", f"""
WITH x AS (SELECT conv_id, turn, {tokens('text')} AS tokens FROM conversations),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cum_tokens FROM x)
SELECT conv_id, turn, tokens, cum_tokens FROM c WHERE cum_tokens < {BUDGET}
""")
def win_budget_cut(t):
    """ordered prefix whose running token sum stays below the budget."""
    c = t.conversations.withColumn("tokens", token_count(F.col("text")))
    return W.budget_cut(c, "conv_id", ["turn"], "tokens", BUDGET) \
        .select("conv_id", "turn", "tokens", F.col("cum_tokens").cast("long").alias("cum_tokens"))


@register("win_memory_last5", """
SELECT conv_id, turn, role FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn <= 5
""")
def win_memory_last5(t):
    """last five turns of every conversation."""
    return W.last_n(t.conversations, "conv_id", "turn", 5).select("conv_id", "turn", "role")


@register("win_batch_numbers", f"""
SELECT url_xml, title, year, row_no, CAST(floor((row_no - 1) / {UPSERT_BATCH}) AS BIGINT) AS batch
FROM (SELECT url_xml, title, nullif(year, '1995') AS year, row_number() OVER (PARTITION BY nullif(year, '1995') ORDER BY n, url_xml) AS row_no FROM {IDX_N})
""")
def win_batch_numbers(t):
    """Row number per year (skew-proof) and its write batch; a column is
    carried and one group is NULL (the year 1995 stands for unknown)."""
    idx = _index(t).select("url_xml", "title", F.nullif("year", F.lit("1995")).alias("year"), "n")
    r = W.dense_row_number(idx, ["year"], ["n", "url_xml"], "row_no")
    return r.select("url_xml", "title", "year", "row_no", W.batch_label(F.col("row_no"), UPSERT_BATCH).alias("batch"))


@register("win_latest_per_key", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts)::VARCHAR AS ts
FROM events GROUP BY user_id
""")
def win_latest_per_key(t):
    """newest row per key as a plain aggregate (``max_by``, no sort)."""
    e = t.events
    return e.groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"),
        F.max("ts").cast("string").alias("ts"))


@register("win_last_turn", """
SELECT conv_id, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_text
FROM conversations GROUP BY conv_id
""")
def win_last_turn(t):
    """last element of each ordered list."""
    c = t.conversations
    return c.groupBy("conv_id").agg(W.last_by(F.col("role"), F.col("turn")).alias("last_role"),
                                    W.last_by(F.col("text"), F.col("turn")).alias("last_text"))


# ---------------------------------------------------------------- sorts / limits

@register("top_sorted_by_date", f"""
SELECT *, row_number() OVER (ORDER BY date, doc_key) AS pos FROM (
SELECT CAST(try_strptime(day_id, '%Y%m%d')::DATE AS VARCHAR) AS date,
       concat_ws('-', substr(url_xml, 28, 1), substr(day_id, 1, 4), string_split(url_xml, '-')[-1]) AS doc_key
FROM {IDX})
""")
def top_sorted_by_date(t):
    """G1: corpus sorted by date, ties by the unique key, with each row's place."""
    idx = G.day_index_from_orders(t.orders)
    out = idx.select(D.parse_day_id(F.col("day_id")).cast("string").alias("date"),
                     G.doc_key(F.col("url_xml")).alias("doc_key"))
    return W.dense_row_number(out, [], ["date", "doc_key"], "pos")


@register("top_year_sorted_numbers", f"""
SELECT year, n, title, row_number() OVER (PARTITION BY year ORDER BY n) AS pos FROM {IDX_N}
""")
def top_year_sorted_numbers(t):
    """Each year's documents in number order, with their place in it; a year is cut over many tasks."""
    return W.dense_row_number(_index(t).select("year", "n", "title"), ["year"], ["n"], "pos")


@register("top_by_tokens", f"""
SELECT doc_id, token_count, row_number() OVER (ORDER BY token_count DESC, doc_id) AS pos
FROM (SELECT doc_id, {tokens('text')} AS token_count FROM documents)
""")
def top_by_tokens(t):
    """Documents by token count descending (ties by id), with their place."""
    d = t.documents.select("doc_id", (-token_count(F.col("text"))).alias("_less"))
    return W.dense_row_number(d, [], ["_less", "doc_id"], "pos") \
        .select("doc_id", (-F.col("_less")).alias("token_count"), "pos")


CHUNK_CAP = 1_500  # binds on every test table but the smallest


@register("top_chunk_cap", f"""
SELECT CAST(doc_id AS VARCHAR) || '_chunk' || chunk_no AS text_id
FROM {DOC_CHUNKS} ORDER BY doc_id, chunk_no LIMIT {CHUNK_CAP}
""")
def top_chunk_cap(t):
    """Cap on the number of chunks, in order of document and number (the cap is the feature)."""
    c = doc_chunks(t).select("doc_id", "chunk_no", "text_id")
    return W.first_rows(c, ["doc_id", "chunk_no"], CHUNK_CAP).select("text_id")


# ---------------------------------------------------------------- set operations

@register("set_union_by_name", """
SELECT doc_id, lang, NULL::VARCHAR AS url FROM documents
UNION ALL SELECT page_id, NULL, url FROM pages
""")
def set_union_by_name(t):
    """H1: UNION ALL by name (documents and pages), missing columns NULL."""
    return H.union_all(t.documents.select("doc_id", "lang"),
                       t.pages.select(F.col("page_id").alias("doc_id"), "url"))


@register("set_except", f"""
SELECT unnest({HREFS}) AS href FROM pages WHERE {PAGE_LANG} = 'de'
EXCEPT SELECT unnest({HREFS}) FROM pages WHERE {PAGE_LANG} = 'en'
""")
def set_except(t):
    """H2: links seen on German pages minus those on English pages."""
    links = t.pages.select(page_lang(F.col("html")).alias("lang"),
                           F.explode(M.all_hrefs(F.col("html"))).alias("href"))
    return H.except_distinct(links.where(F.col("lang") == "de").select("href"),
                             links.where(F.col("lang") == "en").select("href"))


@register("set_union_distinct", f"""
SELECT unnest({HREFS}) AS href FROM pages UNION SELECT url FROM pages
""")
def set_union_distinct(t):
    """Accumulated distinct link set: links of all pages and the pages' own urls."""
    links = t.pages.select(F.explode(M.all_hrefs(F.col("html"))).alias("href"))
    return H.union_distinct(links, t.pages.select(F.col("url").alias("href")))
