"""Rank, prompt, report and QA queries."""

from pyspark.sql import functions as F

from textlake.functions import templates as TPL
from textlake.functions import text as X
from textlake.operators import rerank as R
from textlake.params import Params
from textlake.plans.prompts import context_prompts, context_report, conversation_prompts
from textlake.plans.qa import answer_spans, examples_from_turns, model_inputs, split_label
from textlake.plans.retrieval import reranked_contexts, retrieve, with_context
from textlake.operators.text_index import TextIndex
from textlake.registry.base import register
from textlake.registry.retrieval import PAIRS_SQL, TEST_THRESHOLD
from textlake.registry.sqlparts import terms_sql, tokens
from textlake.session import scratch_path

MODELS = ("mistral-7b-instruct", "google-gemma-7b-it", "open-chat-model")
STAMP = "2024/01/01, 00:00:00"  # report time is a parameter, not the clock


def bm25_sql(queries_sql: str, candidates_sql: str | None = None) -> str:
    """DuckDB BM25 over all documents; ``queries_sql`` yields (query_id, text)."""
    cand = ""
    if candidates_sql:
        cand = f" AND (q.query_id, p.doc_id) IN (SELECT query_id, doc_id FROM ({candidates_sql}))"
    return f"""
dt AS (SELECT doc_id, {terms_sql('text')} AS t FROM documents),
post AS (SELECT doc_id, term, dl, count(*) AS tf
         FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dt) GROUP BY doc_id, term, dl),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avgdl FROM dt),
qt AS (SELECT DISTINCT query_id, unnest(list_distinct({terms_sql('text')})) AS term
       FROM ({queries_sql})),
dfs AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term),
scores AS (
  SELECT q.query_id, p.doc_id,
         sum(ln((s.n - dfs.df + 0.5) / (dfs.df + 0.5) + 1.0) * p.tf * 2.2
             / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl))) AS score
  FROM qt q JOIN post p ON p.term = q.term JOIN dfs ON dfs.term = q.term CROSS JOIN stats s
  WHERE TRUE{cand}
  GROUP BY q.query_id, p.doc_id)"""


@register("rank_bm25_top10", f"""
WITH {bm25_sql("SELECT item_id AS query_id, text FROM benchmark")}
SELECT query_id, doc_id, score, rank FROM (
  SELECT query_id, doc_id, round(score, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
  FROM scores) WHERE rank <= 10
""")
def rank_bm25_top10(t):
    """K6: BM25 of every benchmark query against the whole corpus, top 10."""
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return R.bm25_top(q, t.documents, 10, n_queries=t.benchmark.count())


@register("rank_bm25_index", f"""
WITH {bm25_sql("SELECT item_id AS query_id, text FROM benchmark")}
SELECT query_id, doc_id, score, rank FROM (
  SELECT query_id, doc_id, round(score, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
  FROM scores) WHERE rank <= 10
""")
def rank_bm25_index(t):
    """The same top 10 from a stored inverted index; documents are added by language group, in two additions."""
    index = TextIndex(t.spark, scratch_path(t.spark, "text-index"))
    early = F.coalesce(F.col("lang") == "en", F.lit(False))
    index.add(t.documents.where(early))
    index.add(t.documents)
    return index.search(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), 10)


RERANK_KEPT = 4  # of ten hits, so that the cut bites
RERANK_CANDIDATES = f"""
WITH {PAIRS_SQL}
SELECT query_id, vec_id AS doc_id, rank FROM ranked WHERE rank <= 10"""


@register("rank_rerank_hits", f"""
WITH hits AS ({RERANK_CANDIDATES}),
{bm25_sql("SELECT doc_id AS query_id, text FROM documents WHERE doc_id IN (SELECT query_id FROM hits)",
          "SELECT query_id, doc_id FROM hits")},
j AS (SELECT h.query_id, h.doc_id AS vec_id, h.rank, coalesce(round(s.score, 6), 0.0) AS rerank_score
      FROM hits h LEFT JOIN scores s ON s.query_id = h.query_id AND s.doc_id = h.doc_id)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) - 1 AS rank_pos
  FROM j) WHERE rank_pos < {RERANK_KEPT}
""")
def rank_rerank_hits(t):
    """Vector hits reranked by BM25 of the query document's
    text against each hit's text; position 0 is best, the first four stay."""
    q = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = retrieve(q, t.embeddings, Params(), min_score=-2.0, exclude_same_id=True, materialize=True)
    qtext = t.documents.select(F.col("doc_id").alias("query_id"), "text")  # those that were asked are taken of them
    cand = hits.select("query_id", F.col("vec_id").alias("doc_id"))
    s = R.bm25(qtext, t.documents, candidates=cand).withColumn("score", F.round("score", 6))
    out = R.rerank(hits.select("query_id", "vec_id", "rank"), s, RERANK_KEPT)
    return out.select("query_id", "vec_id", "rank", "rerank_score",
                      F.col("rank_pos").cast("long").alias("rank_pos"))


REPORT_SQL = f"""
WITH {PAIRS_SQL},
top AS (SELECT * FROM ranked WHERE rank <= 10 AND score >= {TEST_THRESHOLD}),
h AS (SELECT t.query_id, t.rank, coalesce(split_part(d.text, chr(10), 1), '') AS title,
             coalesce(d.source, '') AS url, t.score,
             {tokens('d.text')} AS tokens
      FROM top t JOIN documents d ON d.doc_id = t.vec_id),
hp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM h)
SELECT query_id, count(*) AS n_docs, CAST(sum(tokens) AS BIGINT) AS tokens_used,
  'Fecha de ejecución: {STAMP}  ' || chr(10) || 'Documentos encontrados: ' || count(*) || '  ' || chr(10) ||
  'Número de tokens usados: ' || sum(tokens) || '  ' || chr(10) ||
  coalesce(string_agg(CASE WHEN pos <= 6 THEN
    '  ' || chr(10) || '  ' || chr(10) || 'Fecha:  ' || chr(9) || '  ' || chr(10) ||
    'Título:  ' || chr(9) || title || '  ' || chr(10) || 'URL:  ' || chr(9) || url || '  ' || chr(10) ||
    'Puntuación:  ' || chr(9) || CAST(trunc(100 * score + 10) AS INTEGER) || '%  ' || chr(10) END,
    '' ORDER BY rank), '') AS report
FROM hp GROUP BY query_id
"""


@register("rag_context_report", REPORT_SQL)
def rag_context_report(t):
    """Per query summary and first 6 hits."""
    q = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = retrieve(q, t.embeddings, Params(), min_score=TEST_THRESHOLD, exclude_same_id=True,
                    materialize=True)
    ctx = with_context(hits, t.documents, "doc_id", "text", q.count(), Params().top_k,
                       keep={"title": X.first_line(F.col("text")), "url": F.col("source")})
    return context_report(ctx.withColumn("date", F.lit(None).cast("string")), STAMP)


def _sql_fill(template: str, **cols: str) -> str:
    out, pos = [], 0
    for m in TPL._PLACEHOLDER.finditer(template):
        out.append("'" + template[pos:m.start()].replace("'", "''") + "'")
        out.append(f"coalesce({cols[m.group(1)]}, '')")
        pos = m.end()
    out.append("'" + template[pos:].replace("'", "''") + "'")
    return " || ".join(out)


MODEL_SQL = "[" + ", ".join(f"'{m}'" for m in MODELS) + "][(conv_id % 3) + 1]"
PROMPT_SQL = f"""
WITH lu AS (SELECT conv_id, arg_max(text, turn) AS query, max(turn) AS q_turn
            FROM conversations WHERE role = 'user' GROUP BY conv_id),
mem AS (SELECT c.* FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
                         FROM conversations) c JOIN lu USING (conv_id)
        WHERE rn <= 5 AND c.turn < lu.q_turn),
ctx AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS context
        FROM mem GROUP BY conv_id),
q AS (SELECT lu.conv_id, lu.query, ctx.context, {MODEL_SQL} AS model FROM lu LEFT JOIN ctx USING (conv_id))
SELECT conv_id, model,
  CASE WHEN contains(model, 'mistral') THEN {_sql_fill(TPL.MISTRAL_TEMPLATE, context='context', query='query')}
       WHEN contains(model, 'google') THEN {_sql_fill(TPL.GOOGLE_TEMPLATE, context='context', query='query')}
       ELSE {_sql_fill(TPL.DEFAULT_TEMPLATE, context='context', query='query')} END AS prompt
FROM q
"""


@register("prompt_by_model", PROMPT_SQL)
def prompt_by_model(t):
    """Memory-window prompt per conversation."""
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]),
                         (F.pmod(F.col("conv_id"), F.lit(3)) + 1).cast("int"))
    return conversation_prompts(t.conversations, model)


CHAIN = Params(rerank_top_n=RERANK_KEPT, token_budget=2_000)
BENCH_MODEL_SQL = "[" + ", ".join(f"'{m}'" for m in MODELS) + "][(query_id % 3) + 1]"
CHAIN_SQL = f"""
WITH {PAIRS_SQL},
hits AS (SELECT query_id, vec_id AS doc_id, rank FROM ranked
         WHERE rank <= 10 AND query_id IN (SELECT item_id FROM benchmark)),
{bm25_sql("SELECT item_id AS query_id, text FROM benchmark", "SELECT query_id, doc_id FROM hits")},
j AS (SELECT h.query_id, h.doc_id, h.rank, coalesce(round(s.score, 6), 0.0) AS rerank_score
      FROM hits h LEFT JOIN scores s ON s.query_id = h.query_id AND s.doc_id = h.doc_id),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) - 1 AS pos
                        FROM j) WHERE pos < {RERANK_KEPT}),
cut AS (SELECT k.query_id, k.pos, d.text AS context, {tokens('d.text')} AS tokens,
               sum({tokens('d.text')}) OVER (PARTITION BY k.query_id ORDER BY k.pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
        FROM kept k JOIN documents d ON d.doc_id = k.doc_id),
ctx AS (SELECT query_id, count(*) AS n_docs, CAST(sum(tokens) AS BIGINT) AS tokens_used,
               string_agg(context, chr(10) || chr(10) ORDER BY pos) AS context
        FROM cut WHERE cum < 2000 GROUP BY query_id),
q AS (SELECT b.item_id AS query_id, b.text AS query, n_docs, tokens_used, context
      FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id LEFT JOIN ctx ON ctx.query_id = b.item_id),
m AS (SELECT *, {BENCH_MODEL_SQL} AS model FROM q)
SELECT query_id, model, coalesce(n_docs, 0) AS n_docs, coalesce(tokens_used, 0) AS tokens_used,
  CASE WHEN contains(model, 'mistral') THEN {_sql_fill(TPL.MISTRAL_TEMPLATE, context='context', query='query')}
       WHEN contains(model, 'google') THEN {_sql_fill(TPL.GOOGLE_TEMPLATE, context='context', query='query')}
       ELSE {_sql_fill(TPL.DEFAULT_TEMPLATE, context='context', query='query')} END AS prompt
FROM m
"""


@register("rag_rerank_prompts", CHAIN_SQL)
def rag_rerank_prompts(t):
    """Benchmark questions -> top 10 -> BM25 rerank -> first 4 ->
    token budget -> prompt from the ranked contexts. The stored vector of the
    same id stands for the question's own."""
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text").join(
        t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    ctx = reranked_contexts(q, t.embeddings, t.documents, CHAIN, min_score=-2.0, exclude_same_id=True)
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.pmod("query_id", F.lit(3)) + 1).cast("int"))
    return context_prompts(ctx, q, model)


INPUTS_SQL = """
WITH u AS (SELECT conv_id, turn, string_split(text, ' ') AS q FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, string_split(text, ' ') AS c FROM conversations WHERE role = 'assistant'),
t AS (SELECT conv_id, turn, list_concat(['[CLS]'], q, ['[SEP]'], c[1:greatest(64 - len(q) - 3, 0)], ['[SEP]'])[1:64] AS t
      FROM u JOIN a USING (conv_id, turn))
SELECT conv_id, turn, array_to_string(list_concat(t, list_transform(range(64 - len(t)), lambda i: '[PAD]')), ' ') AS input_tokens,
       CAST(len(t) AS BIGINT) AS n_mask, CAST(64 AS BIGINT) AS n_all
FROM t
"""


@register("qa_model_inputs", INPUTS_SQL)
def qa_model_inputs(t):
    """Truncated and padded token arrays with their mask (length 64, so that both occur)."""
    x = model_inputs(examples_from_turns(t.conversations), 64)
    return x.select("conv_id", "turn", F.array_join("input_tokens", " ").alias("input_tokens"),
                    F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_mask"),
                    F.size("attention_mask").cast("long").alias("n_all"))


QA_SQL = """
WITH u AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS context FROM conversations WHERE role = 'assistant'),
ex AS (SELECT u.conv_id, u.turn, question, context, string_split(context, '. ')[-1] AS answer_text,
              CAST(length(context) - length(string_split(context, '. ')[-1]) AS INTEGER) AS answer_start,
              len(string_split(question, ' ')) AS q_len
       FROM u JOIN a USING (conv_id, turn)),
tk AS (SELECT conv_id, turn, answer_start, answer_start + length(answer_text) AS end_char,
              greatest(512 - q_len - 3, 0) AS max_ctx,
              unnest(generate_series(0, len(string_split(context, ' ')) - 1)) AS j,
              unnest(string_split(context, ' ')) AS tok
       FROM ex),
off AS (SELECT *, coalesce(sum(length(tok) + 1) OVER (PARTITION BY conv_id, turn ORDER BY j
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM tk),
sp AS (SELECT conv_id, turn,
              max(CASE WHEN st <= answer_start AND answer_start < st + length(tok) THEN j END) AS s,
              max(CASE WHEN st < end_char AND end_char <= st + length(tok) THEN j END) AS e,
              count(*) AS n_ctx_tokens
       FROM off WHERE j < max_ctx GROUP BY conv_id, turn)
SELECT ex.conv_id, ex.turn, ex.answer_start,
       CAST(CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN s ELSE 0 END AS INTEGER) AS start_token,
       CAST(CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN e ELSE 0 END AS INTEGER) AS end_token,
       CAST(coalesce(n_ctx_tokens, 0) AS BIGINT) AS n_ctx_tokens,
       CAST(512 - least(q_len + coalesce(n_ctx_tokens, 0) + 3, 512) AS BIGINT) AS n_padding,
       CASE WHEN ('0x' || substr(md5(CAST(ex.conv_id AS VARCHAR) || '-' || CAST(ex.turn AS VARCHAR)), 1, 7))::BIGINT % 10 < 2
            THEN 'test' ELSE 'train' END AS split
FROM ex LEFT JOIN sp USING (conv_id, turn)
"""


@register("qa_answer_spans", QA_SQL)
def qa_answer_spans(t):
    """Token span of each answer, truncation, split."""
    ex = examples_from_turns(t.conversations)
    out = answer_spans(ex, ["conv_id", "turn"])
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return out.select("conv_id", "turn", "answer_start", "start_token", "end_token",
                      "n_ctx_tokens", "n_padding", split_label(key).alias("split"))
