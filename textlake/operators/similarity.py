"""Exact cosine top-k of many queries against a vector table.

No cross join and no pair table: vectors stay in their own partitions and
are scored against a *bounded* block of queries inside an Arrow batch; each
task keeps only its local top-k per query, and a ``WindowGroupLimit`` merges
the candidates. Top-k under the total order (score desc, vector id asc) is
decomposable, so the local cut is exact.

Two physical strategies, chosen from a checked size:

* ``broadcast`` -- the query matrix (n_queries x dim x 8 bytes) is below
  ``Params.query_block_bytes``: it is shipped once per executor as a
  broadcast variable and vectors are never shuffled.
* ``blocks`` -- larger query sets: queries are hashed into ``NQ`` blocks and
  vectors into ``NV`` blocks that share ``Params.block_group_bytes``;
  block pairs are co-grouped and scored with the same kernel. Memory per
  group is bounded by the budget, never by the data size, and there are
  several groups per core (:func:`block_grid`); the shuffle is
  V*NQ + Q*NV bytes, which is why very large query sets over very large
  stores go to the approximate operator instead.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from textlake.params import Params

# One score tile (vectors x queries, double) and its partition copy.
TILE_BYTES = 32 * 1024 * 1024
_QUERY_TILE = 1024
#: Doubles of vectors that a task of the broadcast strategy scores at once.
BLOCK_BYTES = 16 * 1024 * 1024
#: Copies of its vectors that a scoring group holds at once (Arrow, doubles, reordered rows).
_COPIES = 4
#: Scoring groups per core of the cluster, at least.
_GROUPS_PER_CORE = 4


def _candidates(queries: DataFrame, query_id: str, vectors: DataFrame, vec_id: str) -> T.StructType:
    """Schema of candidate rows; ids keep their own type (numbers or strings)."""
    return T.StructType([T.StructField("query_id", _id_type(queries, query_id)),
                         T.StructField("vec_id", _id_type(vectors, vec_id)),
                         T.StructField("score", T.DoubleType())])


def _id_type(df: DataFrame, name: str) -> T.DataType:
    return T.StringType() if isinstance(df.schema[name].dataType, T.StringType) else T.LongType()


def _unit_rows(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Stack an Arrow/pandas column of arrays into unit rows; zero rows masked."""
    mat = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else \
        np.zeros((0, 0))
    if mat.size == 0:
        return mat, np.zeros(len(vectors), dtype=bool)
    n = np.linalg.norm(mat, axis=1)
    ok = n > 0
    mat[ok] /= n[ok, None]
    return mat, ok


def _compact(cand: pd.DataFrame, k: int) -> pd.DataFrame:
    """Keep the first k rows per query under (score desc, vec_id asc)."""
    cand = cand.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True],
                            kind="mergesort")
    return cand.groupby("query_id", sort=False).head(k)


def _score_block(vids: np.ndarray, vmat: np.ndarray, qids: np.ndarray, qmat: np.ndarray,
                 k: int, exclude_same_id: bool) -> pd.DataFrame:
    """Top-k candidates of one vector block, scored in tiles of both sides.

    A tile holds ``TILE_BYTES`` of scores at most, however many vectors and
    queries the block has. Vectors go by ascending id, so once a query holds k
    rows only a strictly higher score can enter: most tiles cost one product
    and one comparison.
    """
    order = pd.Series(vids).sort_values(kind="stable", na_position="first").index.to_numpy()
    if len(order) and (np.diff(order) < 0).any():
        vids, vmat = vids[order], vmat[order]
    out = [pd.DataFrame({"query_id": qids[:0], "vec_id": vids[:0], "score": np.zeros(0)})]
    rows = max(1, TILE_BYTES // (8 * _QUERY_TILE))
    numbers = vids.dtype != object and qids.dtype != object
    for s in range(0, len(qids), _QUERY_TILE):
        q_ids, q_tile = qids[s:s + _QUERY_TILE], qmat[s:s + _QUERY_TILE]
        least = np.full(len(q_ids), -np.inf)
        q_at, v_at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if exclude_same_id and numbers:
            lo, hi = np.searchsorted(vids, q_ids, "left"), np.searchsorted(vids, q_ids, "right")
        for r in range(0, len(vids), rows):
            sim = q_tile @ vmat[r:r + rows].T  # (queries, vectors)
            if exclude_same_id and numbers:
                for i in np.flatnonzero((lo < hi) & (lo < r + rows) & (hi > r)):
                    sim[i, max(lo[i] - r, 0):hi[i] - r] = -np.inf
            elif exclude_same_id:
                sim[q_ids[:, None] == vids[None, r:r + rows]] = -np.inf
            better = sim > least[:, None]
            most, width = 4 * k * len(q_ids), sim.shape[1]
            if width > k and np.count_nonzero(better) > most:
                np.nan_to_num(sim, copy=False, nan=-np.inf, posinf=-np.inf, neginf=-np.inf)
                kth = np.partition(sim, width - k, axis=1)[:, width - k]
                better &= sim >= kth[:, None]
                if np.count_nonzero(better) > most:  # equal scores: those of the first ids
                    first = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                    chosen = np.zeros_like(better)
                    np.put_along_axis(chosen, first, True, axis=1)
                    better &= chosen
            i, j = np.nonzero(better)
            if not len(i):
                continue
            x = sim[i, j]
            finite = np.isfinite(x)
            q_at, v_at, score = np.append(q_at, i[finite]), np.append(v_at, j[finite] + r), np.append(score, x[finite])
            by = np.lexsort((v_at, -score, q_at))
            q_at, v_at, score = q_at[by], v_at[by], score[by]
            place = np.arange(len(q_at)) - np.searchsorted(q_at, q_at)
            full = place == k - 1
            least[q_at[full]] = score[full]
            kept = place < k
            q_at, v_at, score = q_at[kept], v_at[kept], score[kept]
        if len(q_at):
            out.append(pd.DataFrame({"query_id": q_ids[q_at], "vec_id": vids[v_at], "score": score}))
    return pd.concat(out, ignore_index=True)


def _ids(col) -> np.ndarray:
    """Ids of an Arrow column: 64-bit numbers, or Python strings."""
    x = col.to_numpy(zero_copy_only=False) if hasattr(col, "to_numpy") and not hasattr(col, "combine_chunks") else col.to_numpy()
    return x if x.dtype == object else x.astype(np.int64)


def _broadcast_scorer(bq, k: int, dim: int, exclude_same_id: bool, schema):
    """``mapInArrow`` kernel: the flat float buffer of a block of rows is reshaped
    to an (n, dim) matrix without per-row Python objects."""
    import pyarrow as pa

    def blocks(batches):
        """Batches cut and put together to blocks of about ``BLOCK_BYTES``."""
        rows, held, n = max(1, BLOCK_BYTES // (8 * max(dim, 1))), [], 0
        for rb in batches:
            for at in range(0, rb.num_rows, rows):
                held.append(rb.slice(at, rows))
                n += held[-1].num_rows
                if n >= rows:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        qids, qmat = bq.value
        acc = None
        for block in blocks(batches):
            vmat, ok = _arrow_matrix(block.column("vec"), block.num_rows, dim)
            if not ok.any():
                continue
            vids = _ids(block.column("vid"))
            cand = _score_block(_only(vids, ok), _only(vmat, ok), qids, qmat, k, exclude_same_id)
            acc = cand if acc is None else pd.concat([acc, cand], ignore_index=True)
            if len(acc) > 4 * k * max(len(qids), 1):
                acc = _compact(acc, k)
        if acc is not None and len(acc):
            out = _compact(acc, k)
            yield pa.RecordBatch.from_pandas(out[["query_id", "vec_id", "score"]], schema=schema, preserve_index=False)
    return run


def _arrow_matrix(col, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of a list<float> Arrow column (flat buffer reshaped)."""
    if n == 0:
        return np.zeros((0, dim)), np.zeros(0, dtype=bool)
    arr = col.combine_chunks() if hasattr(col, "combine_chunks") else col
    mat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim)
    norms = np.linalg.norm(mat, axis=1)
    ok = norms > 0
    np.divide(mat, norms[:, None], out=mat, where=ok[:, None])
    return mat, ok


def _only(rows: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """The rows that are ok, without a copy where all are."""
    return rows if ok.all() else rows[ok]


def _block_scorer(k: int, dim: int, exclude_same_id: bool, schema):
    """``cogroup().applyInArrow`` kernel: one (query block, vector block) pair."""
    import pyarrow as pa

    def run(q, v):
        qmat, qok = _arrow_matrix(q.column("qvec"), q.num_rows, dim)
        vmat, vok = _arrow_matrix(v.column("vec"), v.num_rows, dim)
        if not qok.any() or not vok.any():
            return schema.empty_table()
        qids, vids = _only(_ids(q.column("qid")), qok), _only(_ids(v.column("vid")), vok)
        out = _compact(_score_block(vids, _only(vmat, vok), qids, _only(qmat, qok), k, exclude_same_id), k)
        return pa.Table.from_pandas(out[["query_id", "vec_id", "score"]], schema=schema, preserve_index=False)
    return run


def block_grid(n_queries: int, n_vectors: int, dim: int, group_bytes: int, cores: int) -> tuple[int, int]:
    """Blocks of queries and of vectors: groups fit their memory with all copies, and every core has several."""
    half = max(1, group_bytes // (2 * _COPIES))
    nq, nv = (max(1, math.ceil(n * dim * 8 / half)) for n in (n_queries, n_vectors))
    while nq * nv < _GROUPS_PER_CORE * cores and (nq < n_queries or nv < n_vectors):
        if (n_queries / nq >= n_vectors / nv and nq < n_queries) or nv >= n_vectors:
            nq += 1
        else:
            nv += 1
    return nq, nv


def top_k_similar(queries: DataFrame, vectors: DataFrame, k: int, *,
                  query_id: str = "query_id", query_vec: str = "embedding",
                  vec_id: str = "vec_id", vec: str = "embedding",
                  exclude_same_id: bool = False, params: Params = Params(),
                  strategy: str | None = None) -> DataFrame:
    """Top-k vectors per query: ``query_id, rank (1-based), vec_id, score``.

    Ties are broken by vector id. Vectors whose length differs from the
    query dimension, and zero vectors, are never returned.
    """
    spark = queries.sparkSession
    kinds = _candidates(queries, query_id, vectors, vec_id)
    arrow = to_arrow_schema(kinds)
    q = queries.select(F.col(query_id).cast(kinds["query_id"].dataType).alias("qid"), F.col(query_vec).alias("qvec"))
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("qvec")).alias("dim"),
                  F.min(F.size("qvec")).alias("dmin")).first()
    n_q, dim = int(stats["n"] or 0), int(stats["dim"] or 0)
    if n_q and stats["dmin"] != dim:
        raise ValueError("query vectors have mixed dimensions")
    v = vectors.select(F.col(vec_id).cast(kinds["vec_id"].dataType).alias("vid"), F.col(vec).alias("vec")) \
        .where(F.size("vec") == F.lit(dim))
    q_bytes = n_q * dim * 8
    if strategy is None:
        strategy = "broadcast" if q_bytes <= params.query_block_bytes else "blocks"

    if strategy == "broadcast":
        pdf = q.toPandas()
        qmat, ok = _unit_rows(pdf["qvec"].tolist())
        qids = pdf["qid"].to_numpy()
        bq = spark.sparkContext.broadcast((qids[ok], qmat[ok]) if len(qids) else (qids, qmat))
        cand = v.mapInArrow(_broadcast_scorer(bq, k, dim, exclude_same_id, arrow), kinds)
    else:
        n_v = v.count()
        nq_blocks, nv_blocks = block_grid(n_q, n_v, dim, params.block_group_bytes, spark.sparkContext.defaultParallelism)
        # Block ids must have one type on both sides: cogroup hash-partitions
        # each side by its own key values, and a long and an int of the same
        # value hash differently.
        qb = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nq_blocks)).cast("int")) \
              .withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv_blocks - 1))))
        vb = v.withColumn("vb", F.pmod(F.xxhash64("vid"), F.lit(nv_blocks)).cast("int")) \
              .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq_blocks - 1))))
        cand = qb.groupBy("qb", "vb").cogroup(vb.groupBy("qb", "vb")) \
                 .applyInArrow(_block_scorer(k, dim, exclude_same_id, arrow), kinds)

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (cand.withColumn("rank", F.row_number().over(w).cast("long"))
                .where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))


def threshold(hits: DataFrame, min_score: float, score: str = "score") -> DataFrame:
    """C14: keep hits whose score is at least the threshold (equal is kept)."""
    return hits.where(F.col(score) >= F.lit(min_score))


def _signer(bplanes, n_tables: int, n_bits: int, dim: int):
    """Random-hyperplane signature per table, from each Arrow batch at once."""
    import pyarrow as pa

    def run(batches):
        planes = bplanes.value  # (n_tables * n_bits, dim)
        weights = (1 << np.arange(n_bits)).astype(np.int64)
        for rb in batches:
            if rb.num_rows == 0:
                continue
            flat = rb.column("vec").flatten().to_numpy(zero_copy_only=False)
            mat = flat.astype(np.float64).reshape(rb.num_rows, dim)
            bits = (mat @ planes.T > 0).reshape(rb.num_rows, n_tables, n_bits)
            codes = (bits * weights).sum(axis=2).astype(np.int32)
            buckets = pa.array(list(codes), type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("vec"), buckets],
                                             names=["id", "vec", "buckets"])
    return run


#: Recall that the default settings are planned for, above the 0.9 that they promise: the cosines are a sample's.
RECALL = 0.95
#: Queries whose exact neighbours show the cosines of the data.
PROBES = 64
#: Each table copies both sides once, so this bounds what is shuffled; a plan that needs more is answered exactly.
MOST_TABLES = 8
#: Dot products that cost about as much as one shuffled copy of a vector.
COPY_COST = 200


def signature_bits(n_vectors: int, bucket_rows: int = 256, most: int = 24) -> int:
    """Most hyperplanes per table that are of use: buckets of about ``bucket_rows`` vectors."""
    return int(min(most, max(1, round(math.log2(max(n_vectors, 1) / bucket_rows) if n_vectors > bucket_rows else 1))))


def expected_recall(cosines: np.ndarray, weights: np.ndarray, n_bits: int, n_tables: int) -> float:
    """Share of pairs of these cosines that agree in a whole signature of at least one table."""
    agree = 1 - np.arccos(np.clip(cosines, -1, 1)) / np.pi
    return float(np.average(1 - (1 - agree ** n_bits) ** n_tables, weights=weights))


def plan_signatures(cosines: np.ndarray, weights: np.ndarray, n_queries: int, n_vectors: int, n_bits: int | None = None,
                    n_tables: int | None = None) -> tuple[int, int]:
    """(bits, tables) of the least work a vector that reach ``RECALL``; (0, 1), the exact answer, if none saves work.

    A given number of bits or tables is kept; if it cannot reach the recall, the answer is exact.
    """
    best = (0, 1)
    given = n_bits is not None or n_tables is not None
    least = math.inf if given else n_queries
    if not len(cosines):
        return best
    for bits in [n_bits] if n_bits is not None else range(1, signature_bits(n_vectors) + 1):
        for tables in [n_tables] if n_tables is not None else range(1, MOST_TABLES + 1):
            if expected_recall(cosines, weights, bits, tables) >= RECALL:
                work = tables * ((bits + COPY_COST) * (1 + n_queries / n_vectors) + n_queries / 2 ** bits)
                if work < least:
                    best, least = (bits, tables), work
                break
    return best


def _neighbour_cosines(q: DataFrame, v: DataFrame, k: int, exclude_same_id: bool, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of the exact top-k of ``PROBES`` queries, rounded down to 1/100, and how often each occurs."""
    some = q.orderBy(F.xxhash64("id"), "id").limit(PROBES)
    found = top_k_similar(some, v, k, query_id="id", query_vec="vec", vec_id="id", vec="vec",
                          exclude_same_id=exclude_same_id, params=params, strategy="broadcast")
    rows = found.groupBy(F.floor(F.col("score") * 100).alias("c")).count().collect()
    return np.array([r["c"] / 100 for r in rows], float), np.array([r["count"] for r in rows], float)


def approx_top_k(queries: DataFrame, vectors: DataFrame, k: int, *, n_tables: int | None = None,
                 n_bits: int | None = None, seed: int = 17, query_id: str = "query_id",
                 query_vec: str = "embedding", vec_id: str = "vec_id", vec: str = "embedding",
                 exclude_same_id: bool = False, params: Params = Params()) -> DataFrame:
    """Approximate top-k (locality-sensitive hashing on cosine).

    A vector is a candidate for a query when their signatures agree in at
    least one of ``n_tables`` tables of ``n_bits`` random hyperplanes. What is
    not given is planned from the cosines that the exact neighbours of a few
    queries have, so that the expected recall is ``RECALL`` at any size of the
    store; where no plan is less work than scoring all pairs (neighbours of
    low cosine, few queries) the exact operator answers. Each (table, bucket) is cut into a
    grid of query parts x vector parts, from the counted bucket sizes, so
    that neither side of a hot bucket is copied whole into one task; cells
    are scored with the exact kernel, and only local top-k rows leave them --
    no pair table. Scores are exact cosines; only the candidate set is
    approximate, as with the reference's hosted index. ``n_bits=0``
    degenerates to the exact result.
    """
    spark = queries.sparkSession
    kinds = _candidates(queries, query_id, vectors, vec_id)
    arrow = to_arrow_schema(kinds)
    q = queries.select(F.col(query_id).cast(kinds["query_id"].dataType).alias("id"), F.col(query_vec).alias("vec"))
    dim = int(q.agg(F.max(F.size("vec"))).first()[0] or 0)
    v = vectors.select(F.col(vec_id).cast(kinds["vec_id"].dataType).alias("id"), F.col(vec).alias("vec")) \
        .where(F.size("vec") == F.lit(dim))
    q = q.where(F.size("vec") == F.lit(dim))
    if n_bits is None or n_tables is None:
        seen = _neighbour_cosines(q, v, k, exclude_same_id, params)
        n_bits, n_tables = plan_signatures(*seen, q.count(), v.count(), n_bits, n_tables)
        if n_bits == 0:
            return top_k_similar(q, v, k, query_id="id", query_vec="vec", vec_id="id", vec="vec",
                                 exclude_same_id=exclude_same_id, params=params)
    rng = np.random.default_rng(seed)
    bp = spark.sparkContext.broadcast(rng.standard_normal((n_tables * n_bits, dim)))
    rows_per_cell = max(1, params.vector_block_bytes // max(_COPIES * dim * 8, 1))

    def signed(side: DataFrame, name: str, values: str) -> DataFrame:
        schema = T.StructType([side.schema["id"], side.schema["vec"], T.StructField("buckets", T.ArrayType(T.IntegerType()))])
        return side.mapInArrow(_signer(bp, n_tables, n_bits, dim), schema).select(
            F.col("id").alias(name), F.col("vec").alias(values), F.posexplode("buckets").alias("tbl", "bucket"))

    def parts(side: DataFrame, name: str) -> DataFrame:
        n = F.ceil(F.count(F.lit(1)) / F.lit(rows_per_cell)).cast("int")
        return side.groupBy("tbl", "bucket").agg(n.alias(name))

    vs, qs = signed(v, "vid", "vec"), signed(q, "qid", "qvec")
    # a bucket without queries or without vectors gives no candidates
    grid = parts(vs, "n_v").join(parts(qs, "n_q"), ["tbl", "bucket"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    vs = vs.join(grid, ["tbl", "bucket"]).withColumn("v_part", own("vid", "n_v")).withColumn("q_part", every("n_q"))
    qs = qs.join(grid, ["tbl", "bucket"]).withColumn("q_part", own("qid", "n_q")).withColumn("v_part", every("n_v"))
    keys = ["tbl", "bucket", "q_part", "v_part"]
    cand = qs.select("qid", "qvec", *keys).groupBy(*keys).cogroup(vs.select("vid", "vec", *keys).groupBy(*keys)) \
        .applyInArrow(_block_scorer(k, dim, exclude_same_id, arrow), kinds)
    # a pair found in several tables carries the same exact score
    cand = cand.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (cand.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))
