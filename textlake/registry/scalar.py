"""Scalar function queries (S1-S31) with DuckDB twins."""

from pyspark.sql import functions as F

from textlake.functions import dates as D
from textlake.functions import markup as M
from textlake.functions import text as X
from textlake.functions.text import PY_WHITESPACE
from textlake.functions.vectors import cosine, percent_score
from textlake.params import SPANISH_MONTHS
from textlake.registry.base import register
from textlake.registry.sqlparts import GAZETTE_INDEX
from textlake.sources import gazette as G

WS = PY_WHITESPACE
MONTH_LIST = "[" + ", ".join(f"'{m}'" for m, _ in SPANISH_MONTHS) + "]"
MONTH_CASE = "CASE {c} " + " ".join(f"WHEN '{m}' THEN '{n}'" for m, n in SPANISH_MONTHS) + " END"


@register("fn_fold", r"""
SELECT doc_id, lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')) AS folded
FROM documents
""")
def fn_fold(t):
    """NFD fold to lower-case ASCII."""
    return t.documents.select("doc_id", X.fold(F.col("text")).alias("folded"))


@register("fn_clean_text", f"""
SELECT doc_id, trim(regexp_replace(text, '[{WS}|]+', ' ', 'g')) AS clean
FROM documents
""")
def fn_clean_text(t):
    """S3: newline and '|' to space, whitespace collapsed, trimmed."""
    return t.documents.select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@register("fn_split_last", f"""
SELECT url_xml, string_split(url_xml, '-')[-1] AS number, string_split(url_xml, '-')[-2] AS year
FROM ({GAZETTE_INDEX})
""")
def fn_split_last(t):
    """Last and second-last pieces of a split."""
    idx = G.day_index_from_orders(t.orders)
    return idx.select("url_xml", X.split_last(F.col("url_xml"), "-").alias("number"),
                      X.split_last(F.col("url_xml"), "-", 2).alias("year"))


@register("fn_zero_pad", f"""
SELECT url_xml, printf('%s_%06d', string_split(url_xml, '-')[-2],
                       CAST(string_split(url_xml, '-')[-1] AS BIGINT)) AS file_name
FROM ({GAZETTE_INDEX})
""")
def fn_zero_pad(t):
    """``{year}_{n:06}`` file names."""
    idx = G.day_index_from_orders(t.orders)
    return idx.select("url_xml", F.concat(X.split_last(F.col("url_xml"), "-", 2), F.lit("_"),
                                          X.zero_pad(X.split_last(F.col("url_xml"), "-"), 6)).alias("file_name"))


@register("fn_starts_ends", """
SELECT doc_id, starts_with(text, 'E') AS starts_e, ends_with(text, '.') AS ends_dot,
       starts_with(source, 'src1') AS src1
FROM documents
""")
def fn_starts_ends(t):
    """Startswith / endswith."""
    d = t.documents
    return d.select("doc_id", F.col("text").startswith("E").alias("starts_e"),
                    F.col("text").endswith(".").alias("ends_dot"),
                    F.col("source").startswith("src1").alias("src1"))


@register("fn_doc_key", f"""
SELECT url_xml,
       CASE WHEN regexp_extract(url_xml, '{G.KEY_PATTERN}', 3) <> '' THEN
         concat_ws('-', regexp_extract(url_xml, '{G.KEY_PATTERN}', 1),
                        regexp_extract(url_xml, '{G.KEY_PATTERN}', 2),
                        regexp_extract(url_xml, '{G.KEY_PATTERN}', 3)) END AS doc_key
FROM ({GAZETTE_INDEX})
""")
def fn_doc_key(t):
    """``class-year-number`` from the item url."""
    idx = G.day_index_from_orders(t.orders)
    return idx.select("url_xml", G.doc_key(F.col("url_xml")).alias("doc_key"))


@register("fn_first_href", """
SELECT page_id, NULLIF(regexp_extract(html, 'a href="([^"]*)"', 1), '') AS href FROM pages
""")
def fn_first_href(t):
    """First link between ``a href="`` and the next quote."""
    return t.pages.select("page_id", M.first_href(F.col("html")).alias("href"))


@register("fn_drop_amp", r"""
SELECT page_id,
       replace(NULLIF(regexp_extract(html, '<title(?:\s[^>]*)?>([^<]*)</title>', 1), ''),
               'amp;', '') AS title
FROM pages
""")
def fn_drop_amp(t):
    """S10 + S18: title text with the literal ``amp;`` removed."""
    return t.pages.select("page_id", M.drop_amp(M.first_tag_text(F.col("html"), "title"))
                          .alias("title"))


@register("fn_strip_newline", r"""
SELECT conv_id, turn, trim(regexp_replace(text || CASE turn % 3 WHEN 0 THEN chr(10) WHEN 1 THEN chr(10) || chr(10) ELSE '' END,
                                          '\n\z', '')) AS stripped FROM conversations
""")
def fn_strip_newline(t):
    """One trailing newline removed, then spaces trimmed (texts with none, one and two)."""
    c = t.conversations
    ends = F.concat("text", F.repeat(F.lit("\n"), F.element_at(F.array(F.lit(1), F.lit(2), F.lit(0)), (F.col("turn") % 3 + 1).cast("int"))))
    return c.select("conv_id", "turn", F.trim(X.strip_newline_suffix(ends)).alias("stripped"))


@register("fn_char_byte_len", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars_calc, CAST(strlen(text) AS BIGINT) AS n_bytes
FROM documents
""")
def fn_char_byte_len(t):
    """Characters and UTF-8 bytes."""
    d = t.documents
    return d.select("doc_id", X.char_count(F.col("text")).alias("n_chars_calc"),
                    X.byte_count(F.col("text")).alias("n_bytes"))


@register("fn_title_tag", r"""
SELECT page_id,
       NULLIF(regexp_extract(html, '<title(?:\s[^>]*)?>([^<]*)</title>', 1), '') AS title,
       NULLIF(regexp_extract(html, '<h1(?:\s[^>]*)?>([^<]*)</h1>', 1), '') AS h1
FROM pages
""")
def fn_title_tag(t):
    """S18 (native form): first ``title`` and ``h1`` text."""
    p = t.pages
    return p.select("page_id", M.first_tag_text(F.col("html"), "title").alias("title"),
                    M.first_tag_text(F.col("html"), "h1").alias("h1"))


LIST_ITEM = '<li><a href="([^"]*)">([^<]*)</a>'


@register("src_day_index_items", f"""
SELECT page_id, unnest(generate_series(1, len(h))) AS pos, unnest(h) AS href, unnest(x) AS text
FROM (SELECT page_id, regexp_extract_all(html, '{LIST_ITEM}', 1) AS h,
             regexp_extract_all(html, '{LIST_ITEM}', 2) AS x FROM pages)
""")
def src_day_index_items(t):
    """Repeating items of each page, in page order."""
    p = t.pages.select("page_id", F.posexplode(M.list_items(F.col("html"))).alias("p", "it"))
    return p.select("page_id", (F.col("p") + 1).cast("long").alias("pos"),
                    F.col("it.href").alias("href"), F.col("it.text").alias("text"))


@register("fn_parse_day", f"""
SELECT day_id, CAST(try_strptime(day_id, '%Y%m%d')::DATE AS VARCHAR) AS day
FROM ({GAZETTE_INDEX})
""")
def fn_parse_day(t):
    """``yyyyMMdd`` to a date."""
    idx = G.day_index_from_orders(t.orders)
    return idx.select("day_id", D.parse_day_id(F.col("day_id")).cast("string").alias("day"))


@register("fn_weekday_next_day", """
SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
       CAST(isodow(CAST(ts AS DATE)) - 1 AS INTEGER) AS weekday,
       CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS DATE)::VARCHAR AS next_day
FROM events
""")
def fn_weekday_next_day(t):
    """Weekday (Monday 0) and the following day."""
    d = t.events.select(F.to_date("ts").alias("d")).distinct()
    return d.select(F.col("d").cast("string").alias("day"), F.weekday("d").alias("weekday"),
                    F.date_add("d", 1).cast("string").alias("next_day"))


SPANISH_PAT = r"(\d{2})\sde\s(\w+)\sde\s(\d{4})"


def _grp(i: int) -> str:
    return "regexp_extract(long_date, '" + SPANISH_PAT + "', " + str(i) + ")"


SPANISH_SQL = (
    "SELECT event_id, long_date, CASE WHEN " + MONTH_CASE.format(c=_grp(2)) + " IS NOT NULL "
    "AND " + _grp(1) + " <> '' THEN concat_ws('/', " + _grp(1) + ", "
    + MONTH_CASE.format(c=_grp(2)) + ", " + _grp(3) + ") END AS ddmmyyyy "
    "FROM (SELECT event_id, 'Sentencia de ' || strftime(ts, '%d') || ' de ' || "
    + MONTH_LIST + "[month(ts)] || ' de ' || strftime(ts, '%Y') AS long_date FROM events)")


@register("fn_spanish_date", SPANISH_SQL)
def fn_spanish_date(t):
    """``DD de MES de YYYY`` inside a text to ``DD/MM/YYYY``."""
    e = t.events.select("event_id", F.concat(F.lit("Sentencia de "),
                                              D.spanish_long_format(F.col("ts"))).alias("long_date"))
    return e.select("event_id", "long_date", D.spanish_long_date(F.col("long_date")).alias("ddmmyyyy"))


@register("fn_year_start_stamp", """
SELECT event_id, '01/01/' || strftime(ts, '%Y') AS year_start,
       strftime(ts, '%Y/%m/%d, %H:%M:%S') AS stamp
FROM events
""")
def fn_year_start_stamp(t):
    """Year start of a ``dd/mm/yyyy`` date; timestamp text."""
    e = t.events
    return e.select("event_id", D.year_start(F.date_format("ts", "dd/MM/yyyy")).alias("year_start"),
                    D.stamp(F.col("ts")).alias("stamp"))


@register("fn_cosine_pairs", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
       CAST(trunc(100 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 10) AS INTEGER)::VARCHAR || '%' AS shown
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def fn_cosine_pairs(t):
    """Cosine of consecutive vectors, and its display percent."""
    a = t.embeddings.select("vec_id", F.col("embedding").alias("a"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    s = a.join(b, "vec_id").withColumn("s", cosine(F.col("a"), F.col("b")))
    return s.select("vec_id", F.round("s", 6).alias("score"), percent_score(F.col("s")).alias("shown"))


@register("fn_div_mod", """
SELECT event_id, CAST(ceil(value / 7) AS BIGINT) AS ceil7, CAST(floor(value / 7) AS BIGINT) AS floor7,
       event_id % 7 AS mod7
FROM events
""")
def fn_div_mod(t):
    """Ceil / floor division and modulo."""
    e = t.events
    return e.select("event_id", F.ceil(F.col("value") / 7).cast("long").alias("ceil7"),
                    F.floor(F.col("value") / 7).cast("long").alias("floor7"),
                    F.pmod("event_id", F.lit(7)).cast("long").alias("mod7"))


@register("fn_slice_size", """
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim,
       CAST(embedding[1:3] AS DOUBLE[]) AS head3, CAST(embedding[-1] AS DOUBLE) AS last
FROM embeddings
""")
def fn_slice_size(t):
    """Size, slice and index of an array."""
    e = t.embeddings
    return e.select("vec_id", F.size("embedding").cast("long").alias("dim"),
                    F.slice("embedding", 1, 3).cast("array<double>").alias("head3"),
                    F.element_at("embedding", -1).cast("double").alias("last"))


@register("fn_json_field", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       to_json({'event': event_type, 'k': CAST(json_extract_string(props, '$.k') AS BIGINT)})::VARCHAR AS state
FROM events
""")
def fn_json_field(t):
    """JSON field lookup and JSON state text."""
    e = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select("event_id", "k", F.to_json(F.struct(F.col("event_type").alias("event"),
                                                        F.col("k"))).alias("state"))
