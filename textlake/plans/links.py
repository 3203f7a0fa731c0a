"""Harvest court-ruling links (the data side of the link scraper).

Browser automation is outside the engine; landed result pages are the
input. Links are extracted (S9), empty ones dropped (C19), those already
stored skipped (D1 / H2), cleaned (S10) and made absolute (C5), appended
exactly once (B9), and counted (E9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions.markup import all_hrefs, drop_amp
from textlake.operators.filters import non_empty_link
from textlake.operators.joins import not_yet_stored
from textlake.params import COURT_ROOT
from textlake.sinks.tables import append_new, path_exists


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every ``a href`` of every landed page as ``base_url`` (distinct)."""
    return pages.select(F.explode(all_hrefs(F.col(html))).alias("base_url")).distinct()


def harvest_links(links: DataFrame, stored: DataFrame | None, root: str = COURT_ROOT) -> DataFrame:
    """``base_url, final_url`` of links not yet stored; empty links dropped."""
    new = links if stored is None else not_yet_stored(links, stored, "base_url")
    ok = non_empty_link(new, "base_url").where(F.col("base_url") != "/")
    return ok.select("base_url", F.concat(F.lit(root), drop_amp(F.col("base_url"))).alias("final_url"))


def append_links(links: DataFrame, path: str, root: str = COURT_ROOT) -> DataFrame:
    """One harvest run (B9, D1): new ``base_url, final_url`` pairs are appended
    to the link table at ``path``; the run's E9 counts are returned."""
    spark = links.sparkSession
    stored = spark.read.parquet(path) if path_exists(spark, path) else None
    append_new(harvest_links(links, stored, root), path, ["base_url"])
    return harvest_counts(links)


def harvest_counts(links: DataFrame) -> DataFrame:
    """Resolved vs empty links."""
    good = F.col("base_url").isNotNull() & (F.col("base_url") != "") & (F.col("base_url") != "/")
    return links.agg(F.count_if(good).alias("n_success"), F.count_if(~good).alias("n_fails"))
