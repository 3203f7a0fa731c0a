"""Pair scoring and rerank.

The reference reranks retrieved hits with a neural cross-encoder. The
default scorer here is BM25 over folded ``[a-z0-9]+`` terms with
corpus statistics from the whole document table, computed term-at-a-time:

* postings ``(doc, term, tf, dl)`` come from one explode + partial/final
  aggregation;
* query terms (bounded by the number of queries) are broadcast, so the
  postings are never shuffled for the match;
* the postings of the query vocabulary are dealt out by document, so a hot
  term ("the") is spread over all tasks and a document's scores are summed
  where they are; only each task's best candidates are shuffled.

Where only the best documents of each query are wanted, :func:`bm25_top` never
makes a row of a (query, document) pair: a document is one row of term numbers
and counts, and tiles of documents are scored against all queries at once.

Where pairs are given (rerank), :func:`_pair_scores` never makes a row of a
(pair, term): candidate documents and queries are one packed row each, and a
pair is one row that carries its document's.

A neural scorer plugs in through :func:`score_pairs_with` (Arrow batches).
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textlake.functions.packing import pack, unpack
from textlake.functions.text import fold
from textlake.operators.joins import bounded_broadcast, within_bound
from textlake.operators.partitioning import spread_small
from textlake.session import materialize
from textlake.params import BM25_B, BM25_K1

TERM_PATTERN = "[a-z0-9]+"
#: Distinct terms times queries that one table of weights may hold (doubles, in every task).
TABLE_CELLS = 1 << 23
#: Bytes of doubles of a tile of documents x terms.
TILE_BYTES = 16 << 20
#: Documents whose terms are looked up at once.
_LOOKUP_ROWS = 512
#: Query terms that one table in every task may number; more are scored in as many turns as they need.
VOCABULARY_TERMS = 1 << 22
#: Packed bytes of pairs in a partition, and those that its task unpacks at once.
PAIR_PART_BYTES = 16 << 20
PAIR_RUN_BYTES = 1 << 20
#: Terms that are looked up at once (a longer document goes alone).
_LOOKUP_TERMS = 1 << 19


def terms(c: Column) -> Column:
    """Runs of ``[a-z0-9]`` in the folded text (accents dropped, lower case),
    so accented words stay whole.

    Written as a split on the complement (empty pieces removed): the same
    terms as extracting every match, at about half the cost.
    """
    return F.array_remove(F.split(fold(c), "[^a-z0-9]+"), "")


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             vocabulary: DataFrame | None = None) -> DataFrame:
    """``doc_id, dl, term, tf``.

    With a ``vocabulary`` (the query terms, broadcast) every term outside it
    becomes NULL right after the explode, so partial aggregation folds all
    of a document's other tokens into one ``term = NULL`` row: the table
    holds the postings of the query terms plus one length row per document,
    and the corpus statistics need no second tokenisation.
    """
    d = spread_small(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_x")))
    d = d.select("doc_id", terms(F.col("_x")).alias("_t")).withColumn("dl", F.size("_t"))
    tok = d.select("doc_id", "dl", F.explode_outer("_t").alias("term"))
    if vocabulary is not None:
        v = vocabulary.select(F.col("term").alias("_v"))
        tok = tok.join(v, F.col("term") == F.col("_v"), "left") \
            .withColumn("term", F.when(F.col("_v").isNotNull(), F.col("term"))).drop("_v")
    return tok.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """Distinct terms of each query (a term counts once per query)."""
    return queries.select(F.col(query_id).alias("query_id"),
                          F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))


def bm25(queries: DataFrame, docs: DataFrame, *, query_id: str = "query_id",
         query_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text",
         candidates: DataFrame | None = None, n_queries: int | None = None,
         candidates_bound: int | None = None,
         k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """``query_id, doc_id, score`` for every matching (query, doc) pair.

    ``candidates`` (``query_id, doc_id``) restricts scoring to retrieved
    pairs (rerank, by :func:`_pair_scores`; they are counted, so
    ``candidates_bound`` is not needed); corpus statistics always come from
    all of ``docs``. The query-term table is bounded by the number of
    queries; when that count is known it is broadcast explicitly, otherwise
    the optimizer's size-checked broadcast applies. ``doc_id`` is a key of
    ``docs``.
    """
    if candidates is not None:
        return _pair_scores(queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("_x")),
                            docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("_x")), candidates, k1, b)
    qt = query_terms(queries, query_id, query_text)
    # exact size of the (query, term) table: the broadcast bound is counted,
    # not assumed (long queries have many terms)
    bound = qt.count() if n_queries is not None else None
    vocab = bounded_broadcast(qt.select("term").distinct(), bound)
    # Materialised once in the shared checkpoint folder: it feeds the
    # statistics, the document frequencies and the scores, and the lineage
    # back to the corpus scan is cut.
    table = materialize(postings(docs, doc_id, doc_text, vocab))
    lengths = table.groupBy("doc_id").agg(F.max("dl").alias("dl"))
    n_docs = lengths.select(F.count(F.lit(1))).scalar()
    avgdl = lengths.select(F.avg("dl")).scalar()
    post = table.where(F.col("term").isNotNull())
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    # term-at-a-time over the whole corpus: postings x query terms
    m = post.repartition("doc_id").join(bounded_broadcast(qt, bound), "term")
    # a document's postings meet in one partition (they are few: query terms
    # only), so its scores are summed there and top_n cuts them before the
    # one exchange of candidates; the (query, document) pairs never move
    m = m.join(df, "term")
    part = idf * F.col("tf") * (k1 + 1) / (
        F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return m.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def _runs(sizes: np.ndarray, most: int):
    """Bounds of runs of rows whose sizes add up to ``most``, or of one larger row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _counted(row: np.ndarray, number: np.ndarray, count: np.ndarray, n_rows: int, n_terms: int) -> pa.Array:
    """Packed column of ``n_rows`` rows with the counts of equal (row, number) added up."""
    keys, place = np.unique(row * n_terms + number, return_inverse=True)
    sizes = np.diff(np.searchsorted(keys, np.arange(n_rows + 1, dtype=np.int64) * n_terms))
    return pack(sizes, keys % n_terms, np.bincount(place, count, len(keys)).astype(np.int64))


def _numbered(table):
    """``mapInArrow`` kernel: a text's hashed terms as one packed row of term numbers and counts.

    ``table`` has the hashes of the vocabulary in order, and their numbers.
    """
    def run(batches):
        hashes, numbers = table.value
        for whole in batches:
            n = pc.fill_null(pc.list_value_length(whole.column("_h")), 0).to_numpy(zero_copy_only=False)
            for at, to in _runs(n, _LOOKUP_TERMS):
                b, size = whole.slice(at, to - at), n[at:to]
                found, place = np.unique(b.column("_h").flatten().to_numpy(zero_copy_only=False), return_inverse=True)
                spot = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                number = np.where(hashes[spot] == found, numbers[spot], -1)[place]
                known = number >= 0
                row = np.repeat(np.arange(len(size), dtype=np.int64), size)[known]
                packed = _counted(row, number[known], np.ones(len(row)), len(size), len(hashes))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("dl"), packed], ["id", "dl", "packed"])
    return run


def _merged(n_terms: int):
    """``mapInArrow`` kernel: packed rows of one document and length, and how often each comes, as one packed row."""
    def run(batches):
        for whole in batches:
            lists = whole.column("packed")
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            part, number, count = unpack(lists.flatten())
            row = np.repeat(np.arange(len(size), dtype=np.int64), size)[part]
            count = count * whole.column("n").flatten().to_numpy(zero_copy_only=False)[part]
            packed = _counted(row, number, count, len(size), n_terms)
            yield pa.RecordBatch.from_arrays([whole.column("id"), whole.column("dl"), packed], ["id", "dl", "packed"])
    return run


def _scored_pairs(table, avgdl: float, k1: float, b: float):
    """``mapInArrow`` kernel: ``query_id, doc_id, score`` of each pair that shares terms.

    Rows come by query: first its own (``times`` is 0), then its documents,
    each with its packed terms; ``times`` is how often the pair was given. A
    query's terms are kept from batch to batch.
    """
    def run(batches):
        idf = table.value
        n_terms, query, held = len(idf), None, np.zeros(0, np.int64)
        for whole in batches:
            for at, to in _runs(pc.binary_length(whole.column("packed")).to_numpy(), PAIR_RUN_BYTES):
                part, n = whole.slice(at, to - at), to - at
                ids, times = part.column("query_id"), part.column("times").to_numpy()
                new = np.ones(n, bool)
                new[0] = ids[0].as_py() != query
                new[1:] = pc.not_equal(ids.slice(1), ids.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                group = np.cumsum(new)  # 0 goes on from the rows before
                row, number, tf = unpack(part.column("packed"))
                key, asks = group[row] * n_terms + number, times[row] == 0
                asked = np.unique(np.append(held, key[asks]))
                query, lo = ids[n - 1].as_py(), group[-1] * n_terms
                held = asked[np.searchsorted(asked, lo):] - lo
                if not len(asked):
                    continue
                row, number, tf, key = (x[~asks] for x in (row, number, tf, key))
                met = asked[np.minimum(np.searchsorted(asked, key), len(asked) - 1)] == key
                row, number, tf = row[met], number[met], tf[met]
                if not len(row):
                    continue
                dl = part.column("dl").fill_null(0).to_numpy(zero_copy_only=False)[row]
                gain = idf[number] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)) * times[row]
                score, kept = np.bincount(row, gain, n), np.bincount(row, minlength=n) > 0
                mask = pa.array(kept)
                yield pa.RecordBatch.from_arrays([ids.filter(mask), part.column("doc_id").filter(mask), pa.array(score[kept])],
                                                 ["query_id", "doc_id", "score"])
    return run


def _pair_scores(queries: DataFrame, docs: DataFrame, candidates: DataFrame, k1: float, b: float) -> DataFrame:
    """:func:`bm25` of given pairs: ``query_id, doc_id, score``; a pair that is given twice counts twice.

    One pass over all texts counts the documents of each query term. Candidate
    documents and queries are then packed where they lie (term numbers and
    counts, some two bytes an entry); pairs fetch their document's packed row
    and meet their query's. So texts are never exchanged, and what is grows
    with pairs, not with pairs x terms. Terms are known by 64-bit hashes that
    are checked to differ. Rows of one ``doc_id`` and length are one document.
    """
    spark = docs.sparkSession
    pairs = materialize(candidates.where("query_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("query_id", "doc_id")
                        .agg(F.count(F.lit(1)).cast("int").alias("times")))
    kinds = {c: pairs.schema[c].dataType for c in ("query_id", "doc_id")}
    queries = queries.withColumn("query_id", F.col("query_id").cast(kinds["query_id"]))
    asking, wanted = (materialize(pairs.select(c).distinct()) for c in ("query_id", "doc_id"))

    def listed(rows: DataFrame, ids: DataFrame) -> DataFrame:
        """The rows of these ids if that takes no exchange of texts, else all rows."""
        n = ids.count()
        return rows.join(bounded_broadcast(ids, n), ids.columns[0], "left_semi") if within_bound(ids, n) else rows

    def split(rows: DataFrame, key: str) -> DataFrame:
        return spread_small(rows).select(F.col(key).alias("id"), terms(F.col("_x")).alias("_t"))

    asked, hit = split(listed(queries, asking), "query_id"), split(listed(docs, wanted), "doc_id")
    every = split(docs, "doc_id").select("id", F.size("_t").alias("dl"), F.array_distinct("_t").alias("_t"))

    # one row a term with its number of documents, and (term NULL) one a document id with its number of rows
    own = F.coalesce(F.concat(F.array(F.lit(None).cast("string")), "_t"), F.array(F.lit(None).cast("string")))
    corpus = every.select("id", "dl", F.explode(own).alias("term"))
    alone = lambda c: F.when(F.col("term").isNull(), F.col(c)).alias(c)
    corpus = corpus.select("term", alone("id"), alone("dl"), F.lit(1).alias("n"), F.lit(0).alias("asked"))
    want = asked.select(F.explode(F.array_distinct("_t")).alias("term"), F.lit(None).cast(corpus.schema["id"].dataType).alias("id"),
                        F.lit(None).cast("int").alias("dl"), F.lit(0).alias("n"), F.lit(1).alias("asked"))
    seen = materialize(corpus.unionByName(want).groupBy("term", "id").agg(
        F.sum("n").alias("n"), F.max("asked").alias("asked"), F.max("dl").alias("dl")).where("term IS NULL OR asked = 1 AND n > 0"))
    n_docs, avgdl, n_again = seen.where("term IS NULL").agg(F.count(F.lit(1)), F.avg("dl"), F.count_if(F.col("n") > 1)).first()
    vocabulary = seen.where("term IS NOT NULL").select("term", "n")
    if n_again:  # rows of one id and length count once
        again = bounded_broadcast(seen.where("term IS NULL AND n > 1").select(F.col("id").alias("_id")), n_again)
        rows = every.join(again, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("id", "dl", F.explode("_t").alias("term"))
        more = rows.groupBy("id", "dl", "term").agg((F.count(F.lit(1)) - 1).alias("more")).where("more > 0")
        more = more.groupBy("term").agg(F.sum("more").alias("more"))
        vocabulary = materialize(vocabulary.join(more, "term", "left")
                                 .select("term", (F.col("n") - F.coalesce("more", F.lit(0))).alias("n")))
    for seed in itertools.count():
        hashed = lambda c, seed=F.lit(seed): F.xxhash64(seed, c)
        n_terms, n_hashes = vocabulary.agg(F.count(F.lit(1)), F.count_distinct(hashed("term"))).first()
        if n_terms == n_hashes:
            break

    entries = lambda kind: T.StructType([T.StructField("id", kind), T.StructField("dl", T.IntegerType()),
                                         T.StructField("packed", T.BinaryType())])
    scores = T.StructType([T.StructField("query_id", kinds["query_id"]), T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           T.StructField("score", T.DoubleType())])

    def packed(rows: DataFrame, table) -> DataFrame:
        rows = rows.select("id", F.size("_t").alias("dl"), F.transform("_t", lambda x: hashed(x)).alias("_h"))
        return rows.mapInArrow(_numbered(table), entries(rows.schema["id"].dataType)).where(F.length("packed") > 0)

    turns, found = -(-n_terms // VOCABULARY_TERMS), []
    for turn in range(turns):
        part = vocabulary.select(hashed("term").alias("h"), "n").where(F.pmod("h", F.lit(turns)) == turn).toArrow()
        if not part.num_rows:
            continue
        hashes, df = part["h"].to_numpy(), part["n"].to_numpy()
        often, numbers, by = np.argsort(-df, kind="stable"), np.empty(len(df), np.int32), np.argsort(hashes)
        numbers[often] = np.arange(len(df))  # frequent terms have small numbers, so small gaps
        table = spark.sparkContext.broadcast((hashes[by], numbers[by]))
        idf = spark.sparkContext.broadcast(np.log((n_docs - df[often] + 0.5) / (df[often] + 0.5) + 1.0))
        theirs = materialize(packed(hit, table))
        if n_again:
            theirs = theirs.groupBy("id", "dl", "packed").agg(F.count(F.lit(1)).alias("n")) \
                .groupBy("id", "dl").agg(F.collect_list(F.struct("packed", "n")).alias("p")).select("id", "dl", "p.packed", "p.n")
            theirs = theirs.mapInArrow(_merged(len(df)), entries(hit.schema["id"].dataType))
        mean = theirs.agg(F.avg(F.length("packed"))).first()[0] or 0
        doc_kind = scores["doc_id"].dataType
        met = pairs.join(theirs.withColumnRenamed("id", "doc_id"), "doc_id") \
            .select("query_id", F.col("doc_id").cast(doc_kind).alias("doc_id"), "times", "dl", "packed")
        ours = packed(asked, table).select(F.col("id").alias("query_id"), F.lit(None).cast(doc_kind).alias("doc_id"),
                                           F.lit(0).alias("times"), F.lit(None).cast("int").alias("dl"), "packed")
        ours = ours.join(bounded_broadcast(asking, asking.count()), "query_id", "left_semi")
        n_parts = max(spark.sparkContext.defaultParallelism, math.ceil(mean * pairs.count() / PAIR_PART_BYTES))
        rows = met.unionByName(ours).repartition(n_parts, "query_id").sortWithinPartitions("query_id", "times")
        rows = rows.mapInArrow(_scored_pairs(idf, avgdl, k1, b), scores)
        if turns == 1:
            found.append(rows)
        else:  # the next turn's tables take the place of these
            found.append(materialize(rows))
            table.unpersist()
            idf.unpersist()
    if not found:
        return spark.createDataFrame([], scores)
    return reduce(DataFrame.unionByName, found).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def top_n(scored: DataFrame, n: int, group: str = "query_id", score: str = "score",
          tie: str = "doc_id", name: str = "rank") -> DataFrame:
    """Top-n per group by (score desc, tie asc); 1-based ``rank``."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= n)


def _counts(vocabulary):
    """``mapInArrow`` kernel: each document's terms of the (sorted) vocabulary by number, and how often it has each."""
    def run(batches):
        known = pa.array(vocabulary.value, pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, _LOOKUP_ROWS):
                b = whole.slice(at, _LOOKUP_ROWS)
                lists = b.column("_t")
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                found = pc.index_in(lists.flatten(), value_set=known)
                hit = found.is_valid().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(b.num_rows, dtype=np.int64), sizes)[hit]
                keys, tf = np.unique(doc * len(known) + found.drop_null().to_numpy(), return_counts=True)
                per = pa.array(np.searchsorted(keys, np.arange(b.num_rows + 1, dtype=np.int64) * len(known)), pa.int32())
                out = [pa.ListArray.from_arrays(per, pa.array(x.astype(np.int32))) for x in (keys % len(known), tf)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("dl"), *out], ["doc_id", "dl", "terms", "tfs"])
    return run


def _best_documents(weights, avgdl: float, n: int, k1: float, b: float):
    """``mapInArrow`` kernel: rows (query, doc_id, score) of a task's ``n`` best documents for each query.

    ``weights`` is terms x queries. Scores are rounded to six digits before
    they are ranked; equal ones go by ascending id, so the cut is exact.
    """
    def run(batches):
        table = weights.value
        n_terms, n_queries = table.shape
        width = max(1, TILE_BYTES // (8 * n_terms))
        least = np.zeros(n_queries)
        query, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width)
                sizes = pc.list_value_length(part.column("terms")).to_numpy()
                term, tf = (part.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
                doc = np.repeat(np.arange(part.num_rows), sizes)
                dl = part.column("dl").cast(pa.float64()).fill_null(0).to_numpy()[doc]
                gain = np.zeros((part.num_rows, n_terms))
                gain[doc, term] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                exact = table.T @ gain.T  # (queries, documents)
                rounded = np.round(exact, 6)
                q, d = np.nonzero((exact > 0) & (rounded >= least[:, None]))
                if not len(q):
                    continue
                query, score = np.append(query, q), np.append(score, rounded[q, d])
                ids = np.append(ids, part.column("doc_id").to_numpy()[d])
                by = np.lexsort((ids, -score, query))
                query, ids, score = query[by], ids[by], score[by]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                full = place == n - 1
                least[query[full]] = score[full]
                kept = place < n
                query, ids, score = query[kept], ids[kept], score[kept]
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(ids), pa.array(score)], ["query", "doc_id", "score"])
    return run


def bm25_top(queries: DataFrame, docs: DataFrame, n: int, *, query_id: str = "query_id",
             query_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text",
             n_queries: int | None = None, k1: float = BM25_K1, b: float = BM25_B,
             table_cells: int = TABLE_CELLS) -> DataFrame:
    """``query_id, doc_id, score, rank``: the ``n`` best documents of each query by :func:`bm25`, rounded to six digits.

    Documents are tokenised once and stored as one row each; a task scores
    tiles of them against all queries and keeps its best ``n``, so neither
    postings nor pairs are shuffled. Queries whose terms are more than a table
    of ``table_cells`` weights, and documents whose ids repeat or are not
    whole numbers, go by :func:`bm25` and :func:`top_n`.
    """
    spark = docs.sparkSession

    def joined() -> DataFrame:
        scored = bm25(queries, docs, query_id=query_id, query_text=query_text, doc_id=doc_id, doc_text=doc_text,
                      n_queries=n_queries, k1=k1, b=b)
        return top_n(scored.withColumn("score", F.round("score", 6)), n).select("query_id", "doc_id", "score", "rank")

    qt = materialize(query_terms(queries, query_id, query_text))
    n_terms, n_asked = qt.agg(F.count_distinct("term"), F.count_distinct("query_id")).first()
    if dict(docs.dtypes)[doc_id] not in ("int", "bigint") or not n_terms or n_terms * (n_asked + 1) > table_cells:
        return joined()
    asked = qt.collect()  # at most one row a cell of the table
    vocabulary = sorted({r["term"] for r in asked})
    number = {t: i for i, t in enumerate(vocabulary)}
    place = {q: i for i, q in enumerate(dict.fromkeys(r["query_id"] for r in asked))}
    d = spread_small(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("_x")))
    d = d.select("doc_id", terms(F.col("_x")).alias("_t")).select("doc_id", F.size("_t").alias("dl"), "_t")
    kernel = _counts(spark.sparkContext.broadcast(vocabulary))
    table = materialize(d.mapInArrow(kernel, "doc_id long, dl int, terms array<int>, tfs array<int>"))
    n_docs, n_ids, avgdl = table.agg(F.count(F.lit(1)), F.count_distinct("doc_id"), F.avg("dl")).first()
    if n_docs != n_ids or not avgdl:
        return joined()
    weights = np.zeros((len(vocabulary), len(place)))
    for r in asked:
        weights[number[r["term"]], place[r["query_id"]]] += 1
    df = np.zeros(len(vocabulary))
    for term, count in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a query term
        df[term] = count
    weights *= np.log((n_docs - df + 0.5) / (df + 0.5) + 1.0)[:, None]
    kernel = _best_documents(spark.sparkContext.broadcast(weights), float(avgdl), n, k1, b)
    best = table.mapInArrow(kernel, "query int, doc_id long, score double")
    kind = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("query_id", qt.schema["query_id"].dataType)])
    names = F.broadcast(spark.createDataFrame([(i, q) for q, i in place.items()], kind))
    own = docs.schema[doc_id].dataType
    best = best.join(names, "query").select("query_id", F.col("doc_id").cast(own).alias("doc_id"), "score")
    return top_n(best, n).select("query_id", "doc_id", "score", "rank")


def rerank(hits: DataFrame, pair_scores: DataFrame, n: int, *, group: str = "query_id",
           item: str = "vec_id", retrieval_rank: str = "rank") -> DataFrame:
    """F3 + G6: reorder hits by pair score (missing score = 0), ties by the
    retrieval rank; ``rank_pos`` starts at 0 and only ``rank_pos < n`` stay.

    The reference's rerank had no effect (its result was keyed by the old
    position); this follows its documented intent.
    """
    s = pair_scores.select(F.col("query_id").alias(group), F.col("doc_id").alias(item),
                           F.col("score").alias("rerank_score"))
    h = hits.join(s, [group, item], "left") \
        .withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
    w = Window.partitionBy(group).orderBy(F.desc("rerank_score"), F.asc(retrieval_rank))
    return h.withColumn("rank_pos", F.row_number().over(w) - 1).where(F.col("rank_pos") < n)


def score_pairs_with(pairs: DataFrame, scorer, query_text: str = "query_text",
                     doc_text: str = "doc_text") -> DataFrame:
    """Hook: ``scorer(list[str], list[str]) -> list[float]`` over Arrow batches."""
    @F.pandas_udf("double")
    def _score(q: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(scorer(q.tolist(), d.tolist()), dtype="float64")

    return pairs.withColumn("score", _score(F.col(query_text), F.col(doc_text)))


def expand_queries(queries: DataFrame, docs: DataFrame, *, k: int = 3, n_terms: int = 5,
                   query_id: str = "query_id", query_text: str = "text",
                   doc_id: str = "doc_id", doc_text: str = "text",
                   n_queries: int | None = None) -> DataFrame:
    """K8: pseudo-relevance feedback, ``query_id, expansion``.

    The ``n_terms`` most frequent terms of each query's top-``k`` BM25
    documents that are not already query terms (ties by term) are appended
    as ``query + ': ' + terms``. Only the top documents (queries x k, a
    bounded set) are tokenised again.
    """
    top = materialize(bm25_top(queries, docs, k, query_id=query_id, query_text=query_text, doc_id=doc_id,
                               doc_text=doc_text, n_queries=n_queries).select("query_id", "doc_id"))
    bound = None if n_queries is None else n_queries * k
    top_b = bounded_broadcast(top, bound)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("_x")) \
        .join(bounded_broadcast(top.select("doc_id").distinct(), bound), "doc_id", "left_semi")
    tok = texts.select("doc_id", F.explode(terms(F.col("_x"))).alias("term")).join(top_b, "doc_id")
    counts = tok.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    qt = query_terms(queries, query_id, query_text)
    fresh = counts.join(qt, ["query_id", "term"], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), F.asc("term"))
    best = fresh.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_terms)
    arr = F.array_sort(F.collect_list(F.struct("_r", "term")))
    extra = best.groupBy("query_id").agg(F.array_join(F.transform(arr, lambda x: x["term"]), " ")
                                         .alias("_extra"))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("_q"))
    return q.join(extra, "query_id", "left").select(
        "query_id", F.when(F.col("_extra").isNull(), F.col("_q"))
        .otherwise(F.concat(F.col("_q"), F.lit(": "), F.col("_extra"))).alias("expansion"))
