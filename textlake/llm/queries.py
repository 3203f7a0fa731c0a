"""The ``opN_*`` queries, each over its whole table, and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.session import ensure_checkpoint_dir, ship_package

from . import (decontam, host_rules, jaccard_join, line_spread, lm_backoff, mixing, multiset_hash, ranked_search, token_align,
               token_frames, toxicity_fm, url_filter, warc_convert)
from .common import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: (host, path, action) of the query's URL rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, by a path of any store that Spark reads."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def held_out(doc_id="doc_id"):
    """Rows never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return add


@query("op1_url_filter", r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'allow'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'block'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'allow'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'block' ELSE 'allow' END AS verdict
FROM p""")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules: Bloom filter, then exact join; without a rule it is allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    out = url_filter.filter_urls(read(spark, sf_dir, "pages"), rules, keep=("page_id",))
    return out.select("page_id", "host", "path", "rule", "verdict")


@query("op2_warc_convert", r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
l AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN l.last IS NULL OR l.last = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN l.last <> p.page_id THEN l.last END AS refers_to
FROM p LEFT JOIN l ON p.d = l.d AND p.n >= 1000""")
def op2_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC files, the converter and WARC files with revisits, read back."""
    out = warc_convert.archive_pages(read(spark, sf_dir, "pages"))
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_host_rules", r"""
WITH w AS (
  SELECT doc_id, source, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
s AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT sum(k) / sum(n) AS m, coalesce(var_samp(k / n), 0) - sum(k) / sum(n) * (1 - sum(k) / sum(n)) * avg(1.0 / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 0), 1e6) ELSE 1e6 END AS st FROM p),
j AS (SELECT source, (k + m * st) / (n + st) >= 0.5 AS rejected FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(j.rejected, false) AS kept
FROM b LEFT JOIN j ON b.source = j.source""")
def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and repetition statistics of all documents, base failures, and the verdict of their host."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    stats = host_rules.text_statistics(docs).drop("text").withColumn("base_failed", host_rules.base_rule())
    out = host_rules.apply_host_rules(saved(stats, "host-rule-stats"), "source", "base_failed")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_line_spread", r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
           FROM documents WHERE text IS NOT NULL),
b AS (SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 8)
SELECT l.doc_id, CAST(count(*) FILTER (WHERE regexp_matches(l.line, '[^\x20\x09-\x0D]')) AS BIGINT) AS n_lines,
       CAST(count(b.line) AS BIGINT) AS n_removed,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE b.line IS NULL), '') AS text
FROM l LEFT JOIN b ON l.line = b.line GROUP BY l.doc_id""")
def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that eight or more sources share."""
    return line_spread.remove_boilerplate(read(spark, sf_dir, "documents"))


@query("op5_token_frames")
def op5_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as seekable zstandard frames and read back with their places."""
    return token_frames.tokenise(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under the 3-word Jaccard join at 0.9."""
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op7_toxicity_fm")
def op7_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a factorization machine fitted on the labels that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_fm.train(docs, read(spark, sf_dir, "labels").where(~held_out()))
    out = toxicity_fm.score(docs, model, names=("score", "predicted"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items, with the items and the longest verified overlap."""
    return decontam.find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as the temperature mixture repeats it, with its place in the mixture."""
    out = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "mix.pass_no", "mix.block", "mix.place", "mix.n_tokens")


@query("op10_lm_backoff", r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT c, count(*) AS n FROM t GROUP BY c),
uo AS (SELECT doc_id, t.c, any_value(u.n) AS n, any_value(u.n) - count(*) AS k FROM t JOIN u ON u.c = t.c GROUP BY doc_id, t.c),
p AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, c),
po AS (SELECT doc_id, t.b, t.c, any_value(p.n) - count(*) AS k FROM t JOIN p ON p.b = t.b AND p.c = t.c GROUP BY doc_id, t.b, t.c),
g AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b, c),
go AS (SELECT doc_id, t.a, t.b, t.c, any_value(g.n) - count(*) AS k FROM t JOIN g ON g.a = t.a AND g.b = t.b AND g.c = t.c
       GROUP BY doc_id, t.a, t.b, t.c),
m AS (SELECT count(*) AS n FROM t),
s AS (SELECT t.doc_id,
        CASE WHEN go.k > 0 THEN ln(go.k / pc.k)
             ELSE CASE WHEN t.a IS NULL THEN 0 ELSE ln(0.4) END
                + CASE WHEN po.k > 0 THEN ln(po.k / uc.k)
                       ELSE CASE WHEN t.b IS NULL THEN 0 ELSE ln(0.4) END + ln(u1.n / m.n) END END AS s
      FROM t JOIN uo AS u1 ON u1.doc_id = t.doc_id AND u1.c = t.c
      LEFT JOIN uo AS uc ON uc.doc_id = t.doc_id AND uc.c = t.b
      LEFT JOIN po ON po.doc_id = t.doc_id AND po.b = t.b AND po.c = t.c
      LEFT JOIN po AS pc ON pc.doc_id = t.doc_id AND pc.b = t.a AND pc.c = t.b
      LEFT JOIN go ON go.doc_id = t.doc_id AND go.a = t.a AND go.b = t.b AND go.c = t.c, m)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(x.s, 0), 4) AS score
FROM d LEFT JOIN (SELECT doc_id, sum(s) AS s FROM s GROUP BY doc_id) AS x ON x.doc_id = d.doc_id""")
def op10_lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document by the counts of all others, words up to three."""
    out = lm_backoff.lm_scores(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("score", 4).alias("score"))


@query("op11_ranked_search", r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
a AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM f GROUP BY term), a),
p AS (SELECT f.doc_id, f.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))) AS s
      FROM f JOIN d ON f.doc_id = d.doc_id JOIN w ON f.term = w.term, a),
s AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM q JOIN p ON q.term = p.term GROUP BY item_id, doc_id HAVING sum(s) > 0),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s)
SELECT * FROM r WHERE rank <= 10""")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item, shared term sets scored once."""
    return ranked_search.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op12_multiset_hash")
def op12_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and the likeness of both and of the next document."""
    out = multiset_hash.edited_fingerprints(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", F.base64("vector").alias("fingerprint"),
                      F.base64("edited_vector").alias("edited_fingerprint"), "near_edited", "near_next")


@query("op13_token_align")
def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' ids in every document, and how common the linked id pairs are."""
    digest = {"groups_sha256": F.coalesce(F.sha2("groups", 256), F.lit(""))}
    out = token_align.align_corpus(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES), digest)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
