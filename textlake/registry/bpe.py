"""Byte-pair token counts (K4, E2, E3, F2). No SQL twin: pytest compares with the tokenizer on every text."""

from pyspark.sql import functions as F

from textlake.operators import windows as W
from textlake.operators.bpe import with_bpe_count
from textlake.registry.base import register
from textlake.registry.relational import BUDGET


def vocabulary() -> str:
    """File of a public byte-level vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@register("agg_bpe_tokens_by_lang")
def agg_bpe_tokens_by_lang(t):
    """Total and mean byte-pair token counts per language."""
    d = with_bpe_count(t.documents.select("lang", "text"), vocabulary())
    return d.groupBy("lang").agg(F.sum("tokens").alias("total_tokens"), F.round(F.avg("tokens"), 6).alias("mean_tokens"),
                                 F.count(F.lit(1)).alias("n_docs"))


@register("win_bpe_budget")
def win_bpe_budget(t):
    """F2 / K4: ordered prefix of each conversation whose byte-pair tokens stay below the budget."""
    c = with_bpe_count(t.conversations, vocabulary())
    return W.budget_cut(c, "conv_id", ["turn"], "tokens", BUDGET) \
        .select("conv_id", "turn", "tokens", F.col("cum_tokens").cast("long").alias("cum_tokens"))
