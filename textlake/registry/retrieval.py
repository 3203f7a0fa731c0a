"""Retrieval queries: top-k, threshold, budget, assembly."""

from pyspark.sql import functions as F

from textlake.params import Params
from textlake.plans.retrieval import answer_contexts, retrieve
from textlake.registry.base import register
from textlake.registry.sqlparts import tokens

# The synthetic vectors are random: no pair of distinct vectors reaches the
# 0.5 default, so registered queries use 0.3 (the default is tested in pytest).
TEST_THRESHOLD = 0.3

PAIRS_SQL = """
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id
),
ranked AS (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM pairs
)"""


def flagship(t):
    """Every vector as a query: top-10, threshold, context text, budget, assembly."""
    q = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    return answer_contexts(q, t.embeddings, t.documents, Params(),
                           min_score=TEST_THRESHOLD, exclude_same_id=True)


FLAGSHIP_SQL = f"""
WITH {PAIRS_SQL},
top AS (SELECT * FROM ranked WHERE rank <= 10 AND score >= {TEST_THRESHOLD}),
ctx AS (
  SELECT t.query_id, t.rank, d.text AS context, {tokens('d.text')} AS tokens
  FROM top t JOIN documents d ON d.doc_id = t.vec_id
),
cut AS (
  SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM ctx
)
SELECT query_id, count(*) AS n_docs, CAST(sum(tokens) AS BIGINT) AS tokens_used,
       string_agg(context, chr(10) || chr(10) ORDER BY rank) AS context
FROM cut WHERE cum < 5120 GROUP BY query_id
"""

register("rag_answer_contexts", FLAGSHIP_SQL)(flagship)


@register("join_topk_similarity", f"""
WITH {PAIRS_SQL}
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank <= 10
""")
def topk(t):
    """Exact top-10 cosine neighbours of every vector (self excluded)."""
    q = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = retrieve(q, t.embeddings, Params(), min_score=-2.0, exclude_same_id=True)
    return hits.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@register("flt_score_threshold", f"""
WITH {PAIRS_SQL}
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM ranked
WHERE rank <= 10 AND score >= {TEST_THRESHOLD}
""")
def thresholded(t):
    """C14: top-10 then drop scores below the threshold (equal kept)."""
    q = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = retrieve(q, t.embeddings, Params(), min_score=TEST_THRESHOLD, exclude_same_id=True)
    return hits.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@register("join_topk_approx")
def topk_approx(t):
    """Approximate top-10 neighbours (LSH candidates, exact scores); no
    SQL twin -- pytest checks it against the exact operator."""
    from textlake.operators.similarity import approx_top_k
    q = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = approx_top_k(q, t.embeddings, 10, exclude_same_id=True)
    return hits.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@register("join_topk_index")
def topk_index(t):
    """A trained index of all vectors; queries are those whose id is divisible by 20.
    No SQL twin: pytest measures the recall against the exact operator."""
    from textlake.operators.vector_index import VectorIndex
    from textlake.session import scratch_path
    index = VectorIndex(t.spark, scratch_path(t.spark, "vector-index"))
    index.build(t.embeddings)
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = index.search(q, 10, exclude_same_id=True)
    return hits.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))
