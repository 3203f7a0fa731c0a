"""Queries over keyword tables (C7, S2) and done-sets kept as number ranges."""

from pyspark.sql import functions as F

from textlake.functions.text import fold
from textlake.operators.keywords import with_keywords
from textlake.plans.resume import pending_items, record_done
from textlake.registry.base import register
from textlake.registry.relational import DONE_UNTIL, IDX_N, _index
from textlake.session import scratch_path
from textlake.sinks.tables import read_marks

FOLD_SQL = r"lower(regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g'))"
GROUP = ["cls", "year"]

# The first run reaches DONE_UNTIL and fails where there is no title; the second took the months after, and is
# recorded before the first and once more after it.
FIRST = f"day_id <= '{DONE_UNTIL}' AND title IS NOT NULL"
SECOND = f"day_id > '{DONE_UNTIL}' AND substr(day_id, 5, 2) IN ('03', '04', '11')"


def _recorded(t):
    idx, state = _index(t), scratch_path(t.spark, "done-ranges")
    for ok in (SECOND, FIRST, SECOND):
        record_done(pending_items(idx, state, GROUP, "n").where(ok) if ok == FIRST else idx.where(ok), state, GROUP, "n")
    return idx, state


@register("flt_many_keywords", rf"""
WITH k AS (SELECT DISTINCT unnest(regexp_extract_all({FOLD_SQL.format('text')}, '[a-z]{{5,}}')) AS w FROM benchmark),
d AS (SELECT doc_id, {FOLD_SQL.format('text')} AS f FROM documents)
SELECT doc_id, count(*) AS n_keywords, string_agg(w, ' ' ORDER BY w) AS keywords
FROM d JOIN k ON contains(f, w) GROUP BY doc_id
""")
def flt_many_keywords(t):
    """Documents that contain any long word of the benchmark items, and which, in one pass per text."""
    words = t.benchmark.select(F.explode(F.regexp_extract_all(fold(F.col("text")), F.lit("[a-z]{5,}"), 0)).alias("keyword"))
    found = with_keywords(t.documents.select("doc_id", "text"), words).where(F.size("keywords") > 0)
    return found.select("doc_id", F.size("keywords").cast("long").alias("n_keywords"), F.array_join("keywords", " ").alias("keywords"))


@register("inc_done_ranges", f"""
WITH done AS (SELECT DISTINCT cls, year, n FROM {IDX_N} WHERE ({FIRST}) OR ({SECOND})),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY cls, year ORDER BY n) AS run FROM done)
SELECT cls, year, min(n) AS lo, max(n) AS hi FROM runs GROUP BY cls, year, run
""")
def inc_done_ranges(t):
    """Done numbers per (class, year) as maximal ranges after three recordings, out of order and repeated."""
    _, state = _recorded(t)
    return read_marks(t.spark, state).select("cls", "year", "lo", "hi")


@register("flt_resume_gaps", f"""
SELECT cls, year, n, url_xml FROM {IDX_N} WHERE NOT (({FIRST}) OR ({SECOND}))
""")
def flt_resume_gaps(t):
    """C11: items outside the done ranges, failed ones in the middle included."""
    idx, state = _recorded(t)
    return pending_items(idx, state, GROUP, "n").select("cls", "year", "n", "url_xml")
