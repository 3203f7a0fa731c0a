"""Corpus pipeline: five operators of ``textlake.llm`` in a row over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's ``docs``. All stages but the last
return the columns of documents; the last returns an index of the token files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textlake.llm import decontam, jaccard_join, mixing, token_frames, toxicity_fm
from textlake.llm.common import saved
from textlake.llm.queries import TOKENIZER, held_out, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the factorization machine calls toxic (fitted on the labels not held out)."""
    return toxicity_fm.drop_toxic(docs, read(spark, sf_dir, "labels").where(~held_out()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each component of the five-word Jaccard join at 0.8."""
    return jaccard_join.drop_near_duplicates(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that overlap a benchmark item."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents as the temperature mixture of the sources wants: each once at least, twice at most."""
    return mixing.mix(docs).select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode all documents, write the seekable token files and return their index."""
    return token_frames.tokenise(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_frames", write_tokens),
]

#: Fitted weights, hash orders and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is stored before the next stage reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
