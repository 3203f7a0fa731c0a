"""Host-level quality rules with an empirical beta prior. DataFrame functions only.

Per document: word and repetition statistics and a base rule. Per host: how
many of its documents fail the base rule, shrunk towards the mean of all hosts
with a beta prior whose strength is fitted to the spread between hosts (method
of moments). A host whose shrunk failure rate reaches ``max_rate`` is rejected
and its verdict is joined back to its documents.

Defined cases: NULL text has no words (and fails the base rule); a NULL host
gets no verdict of its own, so its documents stand on the base rule; an empty
table gives an empty result; a single host, or hosts that do not spread, are
shrunk fully to the mean (the prior has then ``MAX_STRENGTH`` documents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, spaces, words_col

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_RATE = 0.5
MAX_STRENGTH = 1e6
SYMBOLS = "#*$%&|<>"


def _covered(places: Column) -> Column:
    """Words covered by 3-word windows that begin at ascending ``places``."""
    gaps = F.transform(F.sequence(F.lit(1), F.size(places) - 1), lambda k: F.least(F.lit(3), places[k] - places[k - 1]))
    return F.when(F.size(places) < 2, F.size(places) * 3).otherwise(
        F.aggregate(gaps, F.lit(3), lambda a, x: a + x)).cast("long")


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (LONG).

    A window is known by a 64-bit hash of its three words. Windows are sorted
    with their places, so a text costs n log n however often it repeats.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__w", words_col(F.col(text)))
    df = df.withColumn("n_words", F.size("__w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.translate(t, spaces(), "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
    df = df.withColumn("__l", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD_CLASS)))
    df = df.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")).drop("__l")
    w = F.col("__w")
    df = df.withColumn("__h", F.when(F.col("n_words") >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
        .otherwise(F.array().cast("array<bigint>"))).drop("__w")
    df = df.withColumn("__rep", F.size(F.array_distinct("__h")) < F.size("__h"))
    # only texts with a repeated window are sorted
    h = F.col("__h")
    df = df.withColumn("__s", F.when(F.col("__rep"), F.sort_array(
        F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("__h")
    s = F.col("__s")
    last = F.size(s) - 1
    twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                     | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])))
    df = df.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__s")
    return df.withColumn("n_repeat_words", F.when(F.col("__rep"), _covered(F.col("__p"))).otherwise(F.lit(0).cast("long"))
                         ).drop("__p", "__rep")


def base_rule() -> Column:
    """True where a document fails: too few words, or over half of them repeated."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(stats: DataFrame, host: str, failed: str, max_rate: float = MAX_RATE) -> DataFrame:
    """Rows (host, n_docs, n_failed, rate, rejected): failure rates under the fitted beta prior.

    With p the raw rates of hosts, m their mean and v their variance less the
    binomial part, the prior's strength is m(1-m)/v - 1 documents.
    """
    by = stats.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    p = F.col("n_failed") / F.col("n_docs")
    prior = by.agg((F.sum("n_failed") / F.sum("n_docs")).alias("m"), F.coalesce(F.var_samp(p), F.lit(0.0)).alias("v"),
                   F.avg(F.lit(1.0) / F.col("n_docs")).alias("inv"))
    own = F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inv")
    strength = F.when(own > 0, F.least(F.greatest(F.col("m") * (1 - F.col("m")) / own - 1, F.lit(0.0)), F.lit(MAX_STRENGTH))
                      ).otherwise(F.lit(MAX_STRENGTH))
    prior = prior.select("m", strength.alias("strength"))
    m, k = prior.select("m").scalar(), prior.select("strength").scalar()
    rate = (F.col("n_failed") + m * k) / (F.col("n_docs") + k)
    return by.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate >= max_rate).alias("rejected"))


def apply_host_rules(stats: DataFrame, host: str, failed: str, max_rate: float = MAX_RATE) -> DataFrame:
    """Add host_rate, host_rejected and kept to every row of ``stats``, which should be a stored table."""
    verdicts = host_verdicts(stats, host, failed, max_rate).select(
        F.col("host").alias("__host"), F.col("rate").alias("host_rate"), F.col("rejected").alias("__rejected"))
    out = stats.join(verdicts, F.col(host) == F.col("__host"), "left")
    out = out.withColumn("host_rejected", F.coalesce("__rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col(failed) & ~F.col("host_rejected")).drop("__host", "__rejected")
