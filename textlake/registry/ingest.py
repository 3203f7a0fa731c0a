"""Ingest queries: P1, P2, P3 over landed tables derived from ``pages``."""

from pyspark.sql import functions as F

from textlake.functions.dates import calendar_rows, day_id
from textlake.operators import windows as W
from textlake.params import GAZETTE_ROOT, Params
from textlake.plans.corpus import build_documents, build_index, format_corpus
from textlake.plans.ingest import ingest_days, ingest_documents
from textlake.registry.base import register
from textlake.session import scratch_path
from textlake.sources.landed import page_lang

# Ten pages a day from 2000 on; class letters by page; every page whose html
# is cut off has failed, and in the first run every third page and day too.
START = "2000-01-01"
KEY = "(['A', 'B', 'C'])[CAST(page_id % 3 AS INTEGER) + 1] || '-' || strftime(day, '%Y') || '-' || CAST(page_id + 1 AS VARCHAR)"
PAGES = f"""(SELECT *, {KEY} AS doc_key, isodow(day) <> 7 AND (page_id // 10) % 7 <> 3 AS day_ok,
                    contains(html, '</html>') AS ok, NULLIF(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang
             FROM (SELECT page_id, html, CAST(DATE '{START}' + CAST(page_id // 10 AS INTEGER) AS DATE) AS day FROM pages))"""


def _pages(t, keyless: bool = False):
    day = F.date_add(F.lit(START).cast("date"), F.floor(F.col("page_id") / 10).cast("int"))
    letter = F.element_at(F.array(*map(F.lit, "ABC")), (F.col("page_id") % 3 + 1).cast("int"))
    key = F.concat_ws("-", letter, F.year(day).cast("string"), (F.col("page_id") + 1).cast("string"))
    if keyless:
        key = F.when(F.col("page_id") % 5 == 0, F.concat(letter, F.lit("-extra-"), F.col("page_id").cast("string"))).otherwise(key)
    return t.pages.select("page_id", "html", day.alias("day"), key.alias("doc_key"), page_lang(F.col("html")).alias("lang"))


def _calendar(t):
    days = _pages(t).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return calendar_rows(days, "a", "b")


def _landed_days(t, first: bool, keyless: bool = False):
    """Day pages with their items nested two levels down; every seventh day fails, first every third too."""
    p = _pages(t, keyless)
    title = F.coalesce(F.concat(F.lit("<titulo>Ley "), "lang", F.lit("</titulo>")), F.lit(""))
    item = F.concat(F.lit("<item>"), title, F.lit("<urlxml>/diario_boe/xml.php?id=BOE-"), "doc_key", F.lit("</urlxml></item>"))
    items = p.groupBy("day").agg(F.array_join(F.sort_array(F.collect_list(item)), "").alias("items"), F.min("page_id").alias("n"))
    body = F.concat(F.lit("<sumario><seccion><departamento>"), "items", F.lit("</departamento></seccion></sumario>"))
    no = F.floor(F.col("n") / 10)
    failed = no % 7 == 3
    failed = failed | (no % 3 == 0) if first else failed
    return items.select(day_id(F.col("day")).alias("day_id"), F.when(failed, 404).otherwise(200).alias("status"), body.alias("body"))


def _landed_docs(t, first: bool, keyless: bool = False):
    """Document pages; a cut-off page fails, first every third too. Each is landed twice, once as a failure."""
    ok = F.col("html").contains("</html>")
    ok = ok & (F.col("page_id") % 3 != 1) if first else ok
    body = F.concat(F.lit("<documento><departamento>"), F.coalesce("lang", F.lit("")), F.lit("</departamento><rango>"),
                    F.md5("html"), F.lit("</rango><texto>"), F.length("html").cast("string"), F.lit("</texto></documento>"))
    url = F.concat(F.lit(GAZETTE_ROOT + "/diario_boe/xml.php?id=BOE-"), "doc_key")
    once = _pages(t, keyless).select(url.alias("url"), F.when(ok, 200).otherwise(500).alias("status"), body.alias("body"))
    return once.unionAll(once.withColumn("status", F.lit(500)))


@register("ingest_day_index", f"""
SELECT strftime(day, '%Y%m%d') AS day_id, '{GAZETTE_ROOT}/diario_boe/xml.php?id=BOE-' || doc_key AS url,
       'Ley ' || lang AS title FROM {PAGES} WHERE day_ok AND page_id % 3 <> 1
""")
def ingest_day_index(t):
    """Nested items of the landed days in two runs; days that failed first come again."""
    state = scratch_path(t.spark, "days")
    ingest_days(_calendar(t), _landed_days(t, True), state)
    ingest_days(_calendar(t), _landed_days(t, False), state)
    return t.spark.read.parquet(f"{state}/index").select("day_id", "url", "title")


@register("ingest_documents", f"""
SELECT 'stored' AS kind, doc_key, lang AS department, md5(html) AS rang, CAST(length(html) AS VARCHAR) AS text
FROM {PAGES} WHERE day_ok AND page_id % 3 <> 1 AND lang IS NOT NULL AND ok
UNION ALL
SELECT 'retry', doc_key, NULL, NULL, NULL FROM {PAGES} WHERE day_ok AND page_id % 3 <> 1 AND lang IS NOT NULL AND NOT ok
""")
def ingest_documents_runs(t):
    """Two runs over landed documents with marks; failed fetches wait in the retry
    table, and those that succeed in the second run leave it although the marks have passed them."""
    state = scratch_path(t.spark, "docs")
    index = build_index(_calendar(t), _landed_days(t, False))
    ingest_documents(index, _landed_docs(t, True), state)
    ingest_documents(index, _landed_docs(t, False), state)
    from textlake.sinks.tables import read_marks
    stored = t.spark.read.parquet(f"{state}/documents").select(
        F.lit("stored").alias("kind"), "doc_key", "department", "rang", "text")
    retry = read_marks(t.spark, f"{state}/retry").select(F.lit("retry").alias("kind"), "doc_key")
    return stored.unionByName(retry, allowMissingColumns=True)


@register("ingest_corpus", f"""
SELECT doc_key, CAST(day AS VARCHAR) AS date, lang AS department, CASE WHEN ok THEN md5(html) END AS rang,
       row_number() OVER (ORDER BY day, doc_key) AS pos
FROM (SELECT * REPLACE (CASE WHEN ok THEN lang END AS lang), lang AS l FROM {PAGES})
WHERE day_ok AND page_id % 3 <> 1 AND l IS NOT NULL
""")
def ingest_corpus(t):
    """P1 -> P2 -> P3 / G1: index, documents (failed ones as NULL fields) and the formatted corpus in date order."""
    index = build_index(_calendar(t), _landed_days(t, False), Params())
    docs = format_corpus(build_documents(index, _landed_docs(t, False), None))
    out = W.dense_row_number(docs.select("doc_key", "date", "department", "rang"), [], ["date", "doc_key"], "pos")
    return out.select("doc_key", F.col("date").cast("string").alias("date"), "department", "rang", "pos")


@register("ingest_keyless", f"""
SELECT 'stored' AS kind, CASE WHEN page_id % 5 <> 0 THEN doc_key END AS doc_key,
       CASE WHEN page_id % 5 <> 0 THEN doc_key ELSE '{GAZETTE_ROOT}/diario_boe/xml.php?id=BOE-' || (['A', 'B', 'C'])[CAST(page_id % 3 AS INTEGER) + 1]
         || '-extra-' || CAST(page_id AS VARCHAR) END AS record_key, md5(html) AS rang
FROM {PAGES} WHERE day_ok AND page_id % 3 <> 1 AND lang IS NOT NULL AND ok
""")
def ingest_keyless(t):
    """Every fifth page has no gazette key; three runs store each of them once, by its url."""
    state = scratch_path(t.spark, "keyless")
    index = build_index(_calendar(t), _landed_days(t, False, True))
    for first in (True, False, False):
        ingest_documents(index, _landed_docs(t, first, True), state)
    out = t.spark.read.parquet(f"{state}/documents")
    return out.select(F.lit("stored").alias("kind"), "doc_key", "record_key", "rang")
