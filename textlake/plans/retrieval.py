"""P7 / P8 / flagship: many queries at once, one lazy plan keyed by query_id.

top-k (bounded blocks) -> threshold -> attach text -> token count ->
running-sum budget -> ordered assembly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions.tokens import token_count
from textlake.operators.embedding import same_model
from textlake.operators.joins import bounded_broadcast, pair_with
from textlake.operators.rerank import bm25, rerank
from textlake.operators.similarity import threshold, top_k_similar
from textlake.operators.windows import budget_cut
from textlake.params import Params
from textlake.session import materialize as materialize_df


def retrieve(queries: DataFrame, store: DataFrame, params: Params = Params(), *,
             k: int | None = None, min_score: float | None = None,
             query_id: str = "query_id", query_vec: str = "embedding",
             vec_id: str = "vec_id", vec: str = "embedding",
             exclude_same_id: bool = False, materialize: bool = False) -> DataFrame:
    """Top-k then score threshold (the threshold never widens k).

    ``materialize`` writes the hit table (queries x k rows at most) to the
    shared checkpoint folder once, for plans that read it several times;
    it also cuts the lineage back to the vector scan.
    """
    k = params.top_k if k is None else k
    if "model_id" in queries.columns and "model_id" in store.columns:
        same_model(queries, store)  # vectors of different encoders are never compared
    hits = top_k_similar(queries, store, k, query_id=query_id, query_vec=query_vec,
                         vec_id=vec_id, vec=vec, exclude_same_id=exclude_same_id,
                         params=params)
    hits = threshold(hits, params.score_threshold if min_score is None else min_score)
    return materialize_df(hits) if materialize else hits


def with_context(hits: DataFrame, docs: DataFrame, doc_key: str, text: str,
                 n_queries: int | None, k: int, keep: dict[str, Column] | None = None) -> DataFrame:
    """Attach each hit's text, its token count and the ``keep`` columns of the
    document, all in one scan.

    Token counts are computed once per *distinct* hit document: the
    documents are first reduced to the hit ids (semi join against the
    broadcast id set, bounded by queries x k), counted, then paired with the
    hits. Neither the corpus nor the hit list is tokenised more than needed.
    """
    bound = None if n_queries is None else n_queries * k
    ids = bounded_broadcast(hits.select(F.col("vec_id").alias("_doc")).distinct(), bound)
    kept = [c.alias(name) for name, c in (keep or {}).items()]
    texts = docs.select(F.col(doc_key).alias("_doc"), F.col(text).alias("context"), *kept) \
        .join(ids, "_doc", "left_semi")
    if bound is not None:
        # The hit documents are few (at most queries x k) but often sit in a
        # handful of files; spreading them before the per-row tokenisation
        # is a shuffle of a bounded set, not of the corpus.
        texts = texts.repartition("_doc")
    texts = texts.withColumn("tokens", token_count(F.col("context")))
    return pair_with(hits, texts, "vec_id", "_doc", hits_bound=bound).drop("_doc")


def assemble(ctx: DataFrame, limit: int, sep: str = "\n\n") -> DataFrame:
    """F2 + E14 + E12: budget cut, then one row per query."""
    kept = budget_cut(ctx, "query_id", ["rank"], "tokens", limit)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "context")))
    return kept.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("tokens").alias("tokens_used"),
        F.array_join(F.transform(ordered, lambda x: x["context"]), sep).alias("context"))


def answer_contexts(queries: DataFrame, store: DataFrame, docs: DataFrame,
                    params: Params = Params(), *, min_score: float | None = None,
                    exclude_same_id: bool = False, doc_key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Flagship: for every query, the budgeted context block in rank order."""
    n_q = queries.count()
    hits = retrieve(queries, store, params, min_score=min_score, exclude_same_id=exclude_same_id,
                    materialize=True)
    ctx = with_context(hits, docs, doc_key, text, n_q, params.top_k)
    return assemble(ctx, params.token_budget)


def reranked_contexts(queries: DataFrame, store: DataFrame, docs: DataFrame, params: Params = Params(), *,
                      min_score: float | None = None, exclude_same_id: bool = False, query_text: str = "text",
                      doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """P7 + P8: top-k, threshold, BM25 rerank of the query's text against the
    hits, the best ``params.rerank_top_n`` of them, cut to the token budget in
    the order of the rerank.

    ``query_id, vec_id, rank (0-based), context, tokens, cum_tokens``.
    """
    n_q = queries.count()
    hits = retrieve(queries, store, params, min_score=min_score, exclude_same_id=exclude_same_id, materialize=True)
    pairs = hits.select("query_id", F.col("vec_id").alias("doc_id"))
    scores = bm25(queries, docs, query_text=query_text, doc_id=doc_key, doc_text=text, candidates=pairs,
                  n_queries=n_q, candidates_bound=n_q * params.top_k).withColumn("score", F.round("score", 6))
    best = rerank(hits, scores, params.rerank_top_n).select("query_id", "vec_id", F.col("rank_pos").cast("long").alias("rank"))
    ctx = with_context(best, docs, doc_key, text, n_q, params.rerank_top_n)
    return budget_cut(ctx, "query_id", ["rank"], "tokens", params.token_budget)
