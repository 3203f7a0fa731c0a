"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent and normalised to
weights. The exponent is bisected: to the largest flattening that keeps the
repetition limit, or to a target entropy. Each source then gets its weight of
the token budget as whole passes over its documents and one partial pass. The
partial pass takes blocks in a seeded random order until its tokens are used,
then documents of the next block in a seeded order; every pass has its own
order of blocks.

Hot sources are spread over blocks of about ``BLOCK_DOCS`` documents; the
running sum over a source works on one row per block, and the one over
documents only inside a block.

Defined cases: NULL sources form a source of their own (empty name); a document
without tokens counts as one token, so that it is passed on like others;
repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, words_col

BLOCK_DOCS = 1000
MAX_REPEAT = 2.0


def temperature_weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Weights proportional to the token shares raised to ``exponent``."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent for s, n in tokens.items()}
    norm = sum(raw.values())
    return {s: x / norm for s, x in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def passes(tokens: dict[str, int], weights: dict[str, float], budget: float | None = None) -> dict[str, float]:
    """Passes over each source for a token budget; without one, the least repeated source has one pass."""
    if budget is None:
        budget = max(n / weights[s] for s, n in tokens.items())
    return {s: weights[s] * budget / n for s, n in tokens.items()}


def solve_exponent(tokens: dict[str, int], max_repeat: float | None = MAX_REPEAT, target_entropy: float | None = None,
                   budget: float | None = None) -> float:
    """Exponent in [0, 1] that meets the target entropy, or else the least that keeps the repetition limit
    (0, equal weights, without either).

    Both measures are monotone in the exponent: a smaller one flattens the
    weights, raising their entropy and the repeats of small sources.
    """
    def too_flat(x: float) -> bool:
        w = temperature_weights(tokens, x)
        if target_entropy is not None:
            return entropy(w) > target_entropy
        return max(passes(tokens, w, budget).values()) > max_repeat

    if target_entropy is None and max_repeat is None or not too_flat(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if too_flat(mid) else (low, mid)
    return high


def mixture(docs: DataFrame, max_repeat: float | None = MAX_REPEAT, target_entropy: float | None = None,
            budget: float | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text",
            seed: int = 17, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Rows (doc_id, key, source, n_tokens, rows, block, copies): how often each document goes into the mixture.

    ``key`` names the row by its contents; rows of equal contents have
    ``rows`` > 1 and are one document of that many times the tokens.
    """
    t = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"),
                    row_key(docs, doc_id, source, text).alias("key"),
                    F.greatest(F.size(words_col(F.col(text))), F.lit(1)).cast("long").alias("n_tokens"))
    t = saved(t.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"),
                                   F.first("n_tokens").alias("n_tokens"), F.count("*").alias("rows")), "mixing-tokens")
    per = t.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("rows")).alias("tokens"), F.count("*").alias("n_docs"))
    per = {r["source"]: r for r in per.collect()}  # one row per source
    if not per:
        zero = F.lit(0).cast("long")
        return t.select("doc_id", "key", "source", "n_tokens", "rows", zero.alias("block"), zero.alias("copies"))
    tokens = {s: r["tokens"] for s, r in per.items()}
    times = passes(tokens, temperature_weights(tokens, solve_exponent(tokens, max_repeat, target_entropy, budget)), budget)
    plan = docs.sparkSession.createDataFrame(
        [(s, math.floor(x + 1e-9), int(max(0.0, x - math.floor(x + 1e-9)) * tokens[s]), -(-per[s]["n_docs"] // block_docs))
         for s, x in times.items()], "source string, full long, part long, n_blocks long")
    t = t.join(F.broadcast(plan), "source")  # one row per source
    t = t.withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("n_blocks")))
    size = F.col("n_tokens") * F.col("rows")
    blocks = t.groupBy("source", "block", "full", "part").agg(F.sum(size).alias("size"))
    order = Window.partitionBy("source").orderBy(block_order(F.col("full"), seed), "block")
    blocks = blocks.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    left = F.col("part") - F.coalesce("before", F.lit(0))
    blocks = blocks.select("source", "block", left.alias("left"), (left >= F.col("size")).alias("whole"))
    # only the block in which a source's budget ends is cut inside
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("key", F.lit(seed + 1)), "key")
    t = t.join(blocks, ["source", "block"])
    cut = t.where(~F.col("whole") & (F.col("left") > 0))
    cut = cut.withColumn("before", F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = cut.withColumn("more", (F.col("before") + size / 2 <= F.col("left")).cast("long")).drop("before")
    rest = t.where(F.col("whole") | (F.col("left") <= 0)).withColumn("more", F.col("whole").cast("long"))
    t = rest.unionByName(cut)
    return t.select("doc_id", "key", "source", "n_tokens", "rows", "block", (F.col("full") + F.col("more")).alias("copies"))


def block_order(pass_no, seed: int):
    """Where a block stands in the permutation of a pass (counted from 0)."""
    return F.xxhash64("source", "block", pass_no.cast("long"), F.lit(seed))


def row_key(docs: DataFrame, doc_id: str, source: str, text: str):
    """Two 64-bit hashes that name a row by its contents."""
    cols = [docs[c] for c in (doc_id, source, text)]
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("second"), *reversed(cols)).alias("b"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17,
        **how) -> DataFrame:
    """Every row of ``docs`` as often as the mixture wants it, with ``mix`` (pass_no, block, place, n_tokens).

    Sorting by ``mix`` gives the blocks of all sources in a seeded random
    order, pass after pass, and inside a block its documents in a seeded order.
    """
    plan = mixture(docs, doc_id=doc_id, source=source, text=text, seed=seed, **how).where("copies > 0")
    plan = plan.select("key", "source", "block", "copies", "n_tokens").withColumn(
        "pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    plan = plan.select(F.col("key").alias("__key"), F.struct(
        "pass_no", block_order(F.col("pass_no"), seed).alias("block"),
        F.xxhash64("key", F.lit(seed + 1)).alias("place"), "n_tokens").alias("mix"))
    return docs.withColumn("__key", row_key(docs, doc_id, source, text)).join(plan, "__key").drop("__key")
