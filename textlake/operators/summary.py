"""K7: extractive summary (row summary -> ``text_summary``).

The reference asked a language model for a summary of each row. The
default here is extractive and fully native: sentences are exploded with
their position, each sentence is scored by the mean inverse sentence
frequency of its terms *within its own document*, the best ``n`` are kept
(ties by position) and re-joined in text order. Every document is
independent, so the work is grouped by document only (bounded by one
text), never by term across the corpus. A model-backed summary plugs in
through :func:`summarize_with` (Arrow batches).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.operators.partitioning import deal
from textlake.operators.rerank import terms

#: Bytes of stored texts whose sentences and terms one task holds.
PART_BYTES = 4 << 20
SENTENCE_PATTERN = r"[^.!?]+[.!?]*"


def sentences(text) -> Column:
    """Array of the trimmed, non-empty sentences of a text."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), 0)
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def extractive_summary(docs: DataFrame, n: int = 3, key: str = "doc_id", text: str = "text",
                       out: str = "text_summary") -> DataFrame:
    """``key, out``: the ``n`` most distinctive sentences in text order.

    score(sentence) = mean over its term occurrences of ln(n_sent / df)
                    = ln(n_sent) - mean(ln df),
    with df the number of sentences of the same document containing the
    term. Documents are dealt out by key once, to tasks of ``PART_BYTES``; tokens are exploded, counted,
    scored and ranked inside the partition of their document (every grouping
    starts with the key), so no token is shuffled.
    """
    d = docs.select(F.col(key).alias("_k"), sentences(F.col(text)).alias("_s"))
    d = deal(d, "_k", docs, PART_BYTES)
    tok = d.select("_k", F.size("_s").alias("n_sent"), F.posexplode("_s").alias("pos", "sentence")) \
        .select("_k", "n_sent", "pos", F.explode(terms(F.col("sentence"))).alias("term"))
    # the sentences of a document with a term, with how often each has it
    per = tok.groupBy("_k", "n_sent", "term", "pos").agg(F.count(F.lit(1)).alias("_c"))
    per = per.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("_k", "term")))
    scored = per.groupBy("_k", "n_sent", "pos").agg(
        (F.sum(F.col("_c") * F.log(F.col("df"))) / F.sum("_c")).alias("_m"))
    scored = scored.select("_k", "pos", F.round(F.log(F.col("n_sent")) - F.col("_m"), 6).alias("score"))
    rk = Window.partitionBy("_k").orderBy(F.desc("score"), F.asc("pos"))
    best = scored.withColumn("_r", F.row_number().over(rk)).where(F.col("_r") <= n)
    best = best.groupBy("_k").agg(F.sort_array(F.collect_list("pos")).alias("_p"))
    chosen = best.join(d, "_k")
    return chosen.select(F.col("_k").alias(key), F.array_join(
        F.transform("_p", lambda i: F.get(F.col("_s"), i)), " ").alias(out))


def summarize_with(df: DataFrame, summarizer, text: str = "text",
                   out: str = "text_summary") -> DataFrame:
    """Hook: ``summarizer(list[str]) -> list[str]`` over Arrow batches."""
    @F.pandas_udf("string")
    def _sum(s: pd.Series) -> pd.Series:
        return pd.Series(summarizer(s.fillna("").tolist()), dtype="object")

    return df.withColumn(out, _sum(F.col(text)))
