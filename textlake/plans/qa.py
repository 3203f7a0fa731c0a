"""Extractive-QA preparation.

Context tokens with character offsets come from ``posexplode`` and a
running sum per example; the answer span is matched to tokens by interval
predicates and ``max(when(...))`` per example (a range join expressed as a
grouped aggregate, never a pair table). Only context tokens are searched
(the reference mixed question tokens with context offsets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.params import QA_MAX_LENGTH, QA_TEST_SHARE


def split_label(key: Column, test_share: float = QA_TEST_SHARE) -> Column:
    """Stable hash split (first 7 hex digits of md5, mod 10)."""
    bucket = F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("long") % 10
    return F.when(bucket < F.lit(int(round(test_share * 10))), "test").otherwise("train")


def answer_spans(ex: DataFrame, keys: list[str], max_length: int = QA_MAX_LENGTH) -> DataFrame:
    """``ex``: keys, question, context, answer_start, answer_text.

    Adds ``start_token``, ``end_token`` (context-relative, (0, 0) when the
    answer is absent or truncated away), ``n_ctx_tokens`` kept and
    ``n_padding`` up to ``max_length`` (special tokens: 3).
    """
    q_len = F.size(F.split(F.col("question"), " "))
    base = ex.withColumn("max_ctx", F.greatest(F.lit(max_length) - q_len - 3, F.lit(0))) \
             .withColumn("start_char", F.col("answer_start")) \
             .withColumn("end_char", F.col("answer_start") + F.length("answer_text"))
    toks = base.select(*keys, "start_char", "end_char", "max_ctx",
                       F.posexplode(F.split(F.col("context"), " ")).alias("j", "tok")) \
        .where(F.col("j") < F.col("max_ctx"))  # the running sum only looks back
    w = Window.partitionBy(*keys).orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    toks = toks.withColumn("start", F.coalesce(F.sum(F.length("tok") + 1).over(w), F.lit(0))) \
               .withColumn("end", F.col("start") + F.length("tok"))
    hit_s = (F.col("start") <= F.col("start_char")) & (F.col("start_char") < F.col("end"))
    hit_e = (F.col("start") < F.col("end_char")) & (F.col("end_char") <= F.col("end"))
    spans = toks.groupBy(*keys).agg(F.max(F.when(hit_s, F.col("j"))).alias("s"),
                                    F.max(F.when(hit_e, F.col("j"))).alias("e"),
                                    F.count(F.lit(1)).alias("n_ctx_tokens"))
    found = F.col("s").isNotNull() & F.col("e").isNotNull()
    out = base.join(spans, keys, "left") \
        .withColumn("n_ctx_tokens", F.coalesce("n_ctx_tokens", F.lit(0)).cast("long")) \
        .withColumn("start_token", F.when(found, F.col("s")).otherwise(0).cast("int")) \
        .withColumn("end_token", F.when(found, F.col("e")).otherwise(0).cast("int")) \
        .withColumn("n_padding", (F.lit(max_length) - F.least(
            q_len + F.col("n_ctx_tokens") + 3, F.lit(max_length))).cast("long"))
    return out.drop("s", "e", "max_ctx", "start_char", "end_char")


def model_inputs(ex: DataFrame, max_length: int = QA_MAX_LENGTH,
                 marks: tuple[str, str, str] = ("[CLS]", "[SEP]", "[PAD]")) -> DataFrame:
    """``input_tokens`` and ``attention_mask``, both of ``max_length``.

    Start mark, question, separator, context, separator; only the context is
    cut (to what the question leaves) and the rest is padding with mask 0. A
    question that fills the length alone is cut at the end of the array.
    """
    start, sep, pad = (F.array(F.lit(m)) for m in marks)
    q = F.split(F.col("question"), " ")
    left = F.greatest(F.lit(max_length) - F.size(q) - 3, F.lit(0))
    real = F.slice(F.concat(start, q, sep, F.slice(F.split(F.col("context"), " "), F.lit(1), left), sep), 1, max_length)
    out = ex.withColumn("_real", real)
    n = F.size("_real")
    return out.withColumn("input_tokens", F.concat("_real", F.array_repeat(pad[0], F.lit(max_length) - n))) \
        .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))) \
        .drop("_real")


def examples_from_turns(turns: DataFrame) -> DataFrame:
    """Question = a user turn, context = the assistant reply after it, answer
    = the context's last sentence (text after the last '. ')."""
    u = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    ex = u.join(a, ["conv_id", "turn"])
    ans = F.substring_index(F.col("context"), ". ", -1)
    return ex.withColumn("answer_text", ans) \
             .withColumn("answer_start", (F.length("context") - F.length(ans)).cast("int"))


def random_split(ex: DataFrame, test_share: float = QA_TEST_SHARE, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """K11 (alternative): seeded ``randomSplit``; the hash split above is
    stable across reruns and input order, this one only for a fixed input."""
    train, test = ex.randomSplit([1.0 - test_share, test_share], seed=seed)
    return train, test
