"""Prompt assembly and context reports, one row per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions.templates import field_block, fill_by_model
from textlake.functions.vectors import percent_score
from textlake.operators.aggregates import ordered_join
from textlake.operators.windows import last_n
from textlake.params import CONTEXTS_SHOWN, MEMORY_TURNS, REPORT_FIELDS, SUMMARY_LABELS


def conversation_prompts(turns: DataFrame, model: Column, memory: int = MEMORY_TURNS) -> DataFrame:
    """Per conversation, the last user turn is the query and the turns
    before it inside the memory window (F4) are the context (E14)."""
    last_user = turns.where(F.col("role") == "user").groupBy("conv_id") \
        .agg(F.max_by("text", "turn").alias("query"), F.max("turn").alias("q_turn"))
    mem = last_n(turns, "conv_id", "turn", memory).join(last_user, "conv_id") \
        .where(F.col("turn") < F.col("q_turn"))
    ctx = mem.groupBy("conv_id").agg(
        ordered_join(F.col("turn"), F.concat_ws(": ", "role", "text"), "\n").alias("context"))
    q = last_user.join(ctx, "conv_id", "left")
    return q.select("conv_id", model.alias("model"),
                    fill_by_model(model, context=F.col("context"), query=F.col("query")).alias("prompt"))


def context_prompts(contexts: DataFrame, queries: DataFrame, model: Column, query_text: str = "text",
                    sep: str = "\n\n") -> DataFrame:
    """One prompt per query from its ranked contexts (``query_id, rank,
    context, tokens``); a query without contexts gets an empty context."""
    ctx = contexts.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("tokens_used"),
        ordered_join(F.col("rank"), F.col("context"), sep).alias("context"))
    q = queries.select("query_id", F.col(query_text).alias("query")).join(ctx, "query_id", "left")
    return q.select("query_id", model.alias("model"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
                    F.coalesce("tokens_used", F.lit(0)).cast("long").alias("tokens_used"),
                    fill_by_model(model, context=F.col("context"), query=F.col("query")).alias("prompt"))


def context_report(hits: DataFrame, stamp: str, shown: int = CONTEXTS_SHOWN) -> DataFrame:
    """Summary lines, then the first ``shown``
    hits as label/value blocks. ``hits``: query_id, rank, date, title, url,
    score, tokens."""
    items = F.array_sort(F.collect_list(F.struct(
        F.col("rank").alias("rank"), F.coalesce("date", F.lit("")).alias("date"),
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"),
        percent_score(F.col("score")).alias("pct"))))
    agg = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_docs"),
                                       F.sum("tokens").alias("tokens_used"), items.alias("items"))
    head = F.concat(
        F.lit(f"{SUMMARY_LABELS[0]}: {stamp}  \n{SUMMARY_LABELS[1]}: "),
        F.col("n_docs").cast("string"), F.lit(f"  \n{SUMMARY_LABELS[2]}: "),
        F.col("tokens_used").cast("string"), F.lit("  \n"))
    labels = list(zip(REPORT_FIELDS, ["date", "title", "url", "pct"]))
    block = field_block(F.slice("items", 1, shown), labels)
    return agg.select("query_id", "n_docs", "tokens_used", F.concat(head, block).alias("report"))
