"""K7 summary, K8 query expansion and P12 link harvest, with DuckDB twins."""

from pyspark.sql import functions as F

from textlake.operators.rerank import expand_queries
from textlake.operators.summary import SENTENCE_PATTERN, extractive_summary
from textlake.params import COURT_ROOT
from textlake.plans.links import append_links, harvest_counts, harvest_links, page_links
from textlake.plans.report import progress_report
from textlake.registry.base import register
from textlake.registry.ranking import bm25_sql
from textlake.registry.sqlparts import GAZETTE_INDEX, terms_sql
from textlake.session import scratch_path
from textlake.sources.landed import page_lang


@register("fn_extractive_summary", f"""
WITH s0 AS (SELECT doc_id, unnest(generate_series(1, len(x))) AS pos, trim(unnest(x)) AS sentence
            FROM (SELECT doc_id, regexp_extract_all(text, '{SENTENCE_PATTERN}') AS x FROM documents)),
s AS (SELECT * FROM s0 WHERE length(sentence) > 0),
ns AS (SELECT doc_id, count(*) AS n_sent FROM s GROUP BY doc_id),
tok AS (SELECT doc_id, pos, unnest({terms_sql('sentence')}) AS term FROM s),
dfs AS (SELECT doc_id, term, count(DISTINCT pos) AS df FROM tok GROUP BY doc_id, term),
m AS (SELECT t.doc_id, t.pos, avg(ln(dfs.df)) AS m FROM tok t JOIN dfs USING (doc_id, term)
      GROUP BY t.doc_id, t.pos),
sc AS (SELECT m.doc_id, m.pos, round(ln(ns.n_sent) - m.m, 6) AS score FROM m JOIN ns USING (doc_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r
                        FROM sc) WHERE r <= 3)
SELECT b.doc_id, string_agg(s.sentence, ' ' ORDER BY b.pos) AS text_summary
FROM best b JOIN s USING (doc_id, pos) GROUP BY b.doc_id
""")
def fn_extractive_summary(t):
    """K7: three most distinctive sentences of every document, in text order."""
    return extractive_summary(t.documents, 3)


@register("rank_query_expansion", f"""
WITH {bm25_sql("SELECT item_id AS query_id, text FROM benchmark")},
top AS (SELECT query_id, doc_id FROM (
          SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id
                 ORDER BY round(score, 6) DESC, doc_id) AS r FROM scores) WHERE r <= 3),
tok AS (SELECT t.query_id, unnest({terms_sql('d.text')}) AS term
        FROM top t JOIN documents d ON d.doc_id = t.doc_id),
cnt AS (SELECT query_id, term, count(*) AS n FROM tok GROUP BY 1, 2),
fresh AS (SELECT * FROM cnt WHERE (query_id, term) NOT IN (SELECT query_id, term FROM qt)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS r
                        FROM fresh) WHERE r <= 5),
ex AS (SELECT query_id, string_agg(term, ' ' ORDER BY r) AS extra FROM best GROUP BY query_id)
SELECT b.item_id AS query_id, CASE WHEN ex.extra IS NULL THEN b.text ELSE b.text || ': ' || ex.extra END AS expansion
FROM benchmark b LEFT JOIN ex ON ex.query_id = b.item_id
""")
def rank_query_expansion(t):
    """K8: benchmark queries expanded with the top terms of their top-3 BM25 documents."""
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return expand_queries(q, t.documents, k=3, n_terms=5, n_queries=t.benchmark.count())


HREFS = "regexp_extract_all(html, 'a href=\"([^\"]*)\"', 1)"
LANG = "NULLIF(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '')"


@register("links_harvest", f"""
WITH l AS (SELECT DISTINCT unnest({HREFS}) AS base_url FROM pages),
stored AS (SELECT DISTINCT unnest({HREFS}) AS base_url FROM pages WHERE {LANG} = 'es')
SELECT base_url, '{COURT_ROOT}' || replace(base_url, 'amp;', '') AS final_url FROM l
WHERE base_url IS NOT NULL AND base_url <> '' AND base_url <> '/'
  AND base_url NOT IN (SELECT base_url FROM stored WHERE base_url IS NOT NULL)
""")
def links_harvest(t):
    """New links of all pages, the Spanish
    pages' links standing for those already stored."""
    links = page_links(t.pages)
    stored = page_links(t.pages.where(page_lang(F.col("html")) == "es"))
    return harvest_links(links, stored)


@register("links_append_runs", f"""
WITH l AS (SELECT DISTINCT unnest({HREFS}) AS base_url FROM pages)
SELECT base_url, '{COURT_ROOT}' || replace(base_url, 'amp;', '') AS final_url FROM l
WHERE base_url IS NOT NULL AND base_url <> '' AND base_url <> '/'
""")
def links_append_runs(t):
    """Two harvest runs (Spanish pages, then all) append their
    new links to one table, the second twice; every link lands once."""
    path = scratch_path(t.spark, "harvest")
    append_links(page_links(t.pages.where(page_lang(F.col("html")) == "es")), path)
    append_links(page_links(t.pages), path)
    append_links(page_links(t.pages), path)
    return t.spark.read.parquet(path)


@register("links_harvest_counts", f"""
WITH l AS (SELECT DISTINCT unnest({HREFS}) AS base_url FROM pages)
SELECT CAST(count_if(base_url IS NOT NULL AND base_url <> '' AND base_url <> '/') AS BIGINT) AS n_success,
       CAST(count_if(NOT (base_url IS NOT NULL AND base_url <> '' AND base_url <> '/')) AS BIGINT) AS n_fails
FROM l
""")
def links_harvest_counts(t):
    """Resolved and empty links."""
    return harvest_counts(page_links(t.pages))


@register("report_progress", """
SELECT substr(day_id, 1, 4) AS grp, count(*) AS total, CAST(count_if(day_id <= '19960101') AS BIGINT) AS done,
       100.0::DOUBLE * count_if(day_id <= '19960101') / count(*) AS pct,
       CAST(ceil(count(*) / 50) AS BIGINT) AS n_batches
FROM (""" + GAZETTE_INDEX + """) GROUP BY 1
UNION ALL
SELECT 'all', count(*), CAST(count_if(day_id <= '19960101') AS BIGINT),
       100.0::DOUBLE * count_if(day_id <= '19960101') / count(*), CAST(ceil(count(*) / 50) AS BIGINT)
FROM (""" + GAZETTE_INDEX + """)
""")
def report_progress(t):
    """Per-year and overall progress of the day index."""
    from textlake.sources.gazette import day_index_from_orders, year_of_day
    idx = day_index_from_orders(t.orders)
    return progress_report(idx, year_of_day(F.col("day_id")), F.col("day_id") <= "19960101")
