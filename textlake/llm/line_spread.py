"""Line dedup by distinct-site spread.

Every line with a word is known by a 128-bit hash. Partial aggregation keeps
one HyperLogLog sketch of sites per line, so a line on every page never meets
in one task. Lines whose estimate lies far above ``min_sites`` are boilerplate
and those far below are not; the ones between get an exact count of distinct
sites. Documents lose their boilerplate lines.

The sketch's relative error is about 1.04 / sqrt(2^LG_K) = 1.6 %; lines within
``MARGIN`` (25 %) of the threshold are counted exactly, so the result equals
exact counting but for an error of 15 standard deviations.

Defined cases: NULL text has no lines and stays NULL; blank lines are kept and
never counted; NULL sites are no site; a line counts once however often a site
repeats it; repeated rows are treated alike and all returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, saved

LG_K = 12
MARGIN = 0.25
MIN_SITES = 8


def line_hashes(line):
    """Two independent 64-bit hashes of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def explode_lines(docs: DataFrame, site: str, text: str, key: str) -> DataFrame:
    """Rows (key, site, pos, a, b): the hashed lines with a word."""
    lines = docs.select(F.col(key).alias("key"), F.col(site).alias("site"),
                        F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    h = line_hashes(F.col("line"))
    return lines.where(F.col("line").rlike(WORD_CLASS)).select("key", "site", "pos", h["a"].alias("a"), h["b"].alias("b"))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Rows (a, b, sites): lines on at least ``min_sites`` distinct sites; sites is exact near the threshold."""
    lines = lines.where(F.col("site").isNotNull())
    est = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    est = saved(est.select("a", "b", F.hll_sketch_estimate("sketch").alias("est"))
                .where(F.col("est") >= min_sites * (1 - MARGIN) - 1), "line-estimates")
    sure = est.where(F.col("est") > min_sites * (1 + MARGIN) + 1)
    near = est.where(F.col("est") <= min_sites * (1 + MARGIN) + 1).select("a", "b")
    exact = lines.join(near, ["a", "b"], "left_semi").groupBy("a", "b", "site").agg(F.count("*").alias("n"))
    exact = exact.groupBy("a", "b").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.select("a", "b", F.col("est").alias("sites")).unionByName(exact)


def remove_boilerplate(docs: DataFrame, doc_id: str = "doc_id", site: str = "source", text: str = "text",
                       min_sites: int = MIN_SITES) -> DataFrame:
    """Rows (doc_id, n_lines, n_removed, text): every document without its boilerplate lines.

    n_lines and n_removed count lines with a word.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(site).alias("site"), F.col(text).alias("text"))
    # two hashes name a row: repeated rows share them, different rows do not
    docs = docs.withColumn("key", F.struct(F.xxhash64("doc_id", "site", "text").alias("a"),
                                           F.xxhash64(F.lit("second"), "text", "site", "doc_id").alias("b")))
    lines = saved(explode_lines(docs, "site", "text", "key"), "lines")
    bad = boilerplate_lines(lines, min_sites)
    hits = lines.select("key", "pos", "a", "b").join(bad.select("a", "b"), ["a", "b"], "left_semi")
    gone = hits.groupBy("key").agg(F.collect_set("pos").alias("gone"))
    out = docs.join(gone, "key", "left")
    parts = F.split("text", "\n", -1)
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    rest = F.when(F.size(gone) == 0, F.col("text")).otherwise(
        F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n"))
    n = F.size(F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: x.rlike(WORD_CLASS)))
    return out.select("doc_id", n.cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"),
                      rest.alias("text"))
