"""Resumable ingest (P1, P2): runs over landed pages with stored marks and retries.

Each run takes what is new above the marks together with the retry table of
the runs before, stores the successes once, and writes the next version of
both. A failed page is thus fetched again however far the marks have moved,
and leaves the retry table when it has succeeded.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions.dates import day_id
from textlake.operators.aggregates import high_water_marks
from textlake.params import Params
from textlake.plans.corpus import build_documents, build_index, fetch_outcomes, success_marks
from textlake.session import materialize
from textlake.sinks.tables import append_new, next_version, path_exists, read_marks, write_marks
from textlake.sources.landed import latest_landing


def ingest_documents(index: DataFrame, landed_docs: DataFrame, state: str, params: Params = Params()) -> None:
    """One run. ``state`` gets documents (by year), marks and retry tables.

    A document is stored once by its ``record_key``: the gazette key, or the
    url where it has none. Marks do not cover those without a key; a later run
    leaves out the urls of theirs that are stored.
    """
    spark = index.sparkSession
    stored = os.path.join(state, "documents")
    if path_exists(spark, stored):
        keyless = spark.read.parquet(stored).where("doc_key IS NULL").select("url")
        index = index.join(keyless, "url", "left_anti")
    marks, retry = (read_marks(spark, os.path.join(state, x)) for x in ("marks", "retry"))
    docs = materialize(build_documents(index, landed_docs, marks, params, retry))
    ok, failed = fetch_outcomes(docs)
    append_new(ok.withColumn("record_key", F.coalesce("doc_key", "url")), stored, ["record_key"], ["year"])
    done = success_marks(ok.where("doc_key IS NOT NULL"))
    if marks is not None:
        done = high_water_marks(done.unionByName(marks), ["cls", "year"], "n", "n")
    # the marks move last: a run that ends before them is done again
    write_marks(failed, os.path.join(state, "retry"), next_version(spark, os.path.join(state, "retry")))
    write_marks(done, os.path.join(state, "marks"), next_version(spark, os.path.join(state, "marks")))


def ingest_days(calendar: DataFrame, landed_days: DataFrame, state: str, params: Params = Params()) -> None:
    """One run over the calendar's days. ``state`` gets index, marks and retry tables."""
    spark = calendar.sparkSession
    marks, retry = (read_marks(spark, os.path.join(state, x)) for x in ("day_marks", "day_retry"))
    days = calendar.withColumn("day_id", day_id(F.col("day")))
    if marks is not None:
        mark = F.coalesce(marks.select(F.max("mark")).scalar(), F.lit(""))
        days = days.where(F.col("day_id") > mark) \
            .unionByName(days.join(retry, "day_id", "left_semi")).dropDuplicates(["day_id"])
    days = materialize(days)
    items = build_index(days, landed_days, params).withColumn("year", F.substring("day_id", 1, 4))
    append_new(items, os.path.join(state, "index"), ["day_id", "url"], ["year"])
    good = latest_landing(landed_days, "day_id").where("status = 200")
    failed = days.select("day_id").join(good, "day_id", "left_anti")
    done = days.select("day_id").join(good, "day_id", "left_semi")
    if marks is not None:
        done = done.unionByName(marks.select(F.col("mark").alias("day_id")))
    write_marks(failed, os.path.join(state, "day_retry"), next_version(spark, os.path.join(state, "day_retry")))
    write_marks(done.agg(F.max("day_id").alias("mark")), os.path.join(state, "day_marks"),
                next_version(spark, os.path.join(state, "day_marks")))
