"""D4 exact top-k: both strategies against numpy brute force; planted vectors."""

import numpy as np
from pyspark.sql import functions as F

from textlake.operators.similarity import threshold, top_k_similar
from textlake.params import Params

from conftest import SMALL


def brute(q, v, k, exclude):
    out = {}
    for qi, qv in q.items():
        scores = []
        for vi, vv in v.items():
            if exclude and vi == qi:
                continue
            a, b = np.asarray(qv, float), np.asarray(vv, float)
            d = np.linalg.norm(a) * np.linalg.norm(b)
            if d == 0 or len(a) != len(b):
                continue
            scores.append((-(a @ b) / d, vi))
        out[qi] = [vi for _, vi in sorted(scores)[:k]]
    return out


def test_strategies_equal_brute_force(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    rows = {r.vec_id: r.embedding for r in e.collect()}
    want = brute(rows, rows, 5, True)
    for strategy, params in (("broadcast", Params()),
                             ("blocks", Params(query_block_bytes=16000, block_group_bytes=60000))):
        got = top_k_similar(q, e, 5, exclude_same_id=True, params=params, strategy=strategy)
        res = {}
        for r in got.orderBy("query_id", "rank").collect():
            res.setdefault(r.query_id, []).append(r.vec_id)
        assert res == want, strategy


def test_auto_strategy_switches_on_size(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    small = top_k_similar(q, e, 3, params=Params(query_block_bytes=32000, block_group_bytes=100000))
    big = top_k_similar(q, e, 3)
    a = sorted(tuple(r) for r in small.select("query_id", "rank", "vec_id").collect())
    b = sorted(tuple(r) for r in big.select("query_id", "rank", "vec_id").collect())
    assert a == b


def test_planted_vectors(spark):
    s = 1 / np.sqrt(2)
    store = spark.createDataFrame([
        (1, [1.0, 0.0]),                 # cosine 1.0
        (2, [float(s), float(s)]),       # cosine 0.7071
        (3, [0.5, float(np.sqrt(3) / 2)]),  # cosine exactly 0.5
        (4, [-1.0, 0.0]),                # cosine -1
        (5, [0.0, 0.0]),                 # zero vector: never returned
        (6, [1.0, 0.0, 0.0]),            # wrong dimension: never returned
    ], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(100, [2.0, 0.0])], "query_id long, embedding array<float>")
    hits = top_k_similar(q, store, 10)
    got = [(r.vec_id, round(r.score, 6)) for r in hits.orderBy("rank").collect()]
    assert [g[0] for g in got] == [1, 2, 3, 4]
    kept = threshold(hits, 0.5).select("vec_id").collect()
    assert sorted(r.vec_id for r in kept) == [1, 2, 3]  # 0.5 itself is kept


def test_ties_broken_by_id(spark):
    store = spark.createDataFrame([(i, [1.0, 1.0]) for i in (9, 3, 7, 1)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 1.0])], "query_id long, embedding array<float>")
    got = [r.vec_id for r in top_k_similar(q, store, 3).orderBy("rank").collect()]
    assert got == [1, 3, 7]


def test_plan_has_no_cross_join(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    plan = top_k_similar(q, e, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_approx_top_k(spark):
    from textlake.operators.similarity import approx_top_k
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id): r.score
             for r in top_k_similar(q, e, 5, exclude_same_id=True).collect()}
    # no hyperplanes: one bucket per table, the exact answer
    same = approx_top_k(q, e, 5, n_tables=1, n_bits=0, exclude_same_id=True)
    assert {(r.query_id, r.vec_id) for r in same.collect()} == set(exact)
    # approximate: every score is an exact cosine, and recall is reported
    got = approx_top_k(q, e, 5, n_tables=8, n_bits=2, exclude_same_id=True).collect()
    rows = {r.vec_id: r.embedding for r in e.collect()}
    for r in got:
        a, b = np.asarray(rows[r.query_id], float), np.asarray(rows[r.vec_id], float)
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-9
    recall = len({(r.query_id, r.vec_id) for r in got} & set(exact)) / len(exact)
    assert recall > 0.5


def test_approx_finds_planted_near_duplicates(spark):
    from textlake.operators.similarity import approx_top_k
    rng = np.random.default_rng(3)
    base = rng.standard_normal((200, 32))
    near = base[:20] + 0.01 * rng.standard_normal((20, 32))
    store = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)],
                                  "vec_id long, embedding array<float>")
    qs = spark.createDataFrame([(1000 + i, [float(x) for x in v]) for i, v in enumerate(near)],
                               "query_id long, embedding array<float>")
    got = {r.query_id: r.vec_id for r in approx_top_k(qs, store, 1, n_tables=4, n_bits=6).collect()}
    assert got == {1000 + i: i for i in range(20)}


def test_approx_hot_bucket_is_split(spark):
    """A third of the vectors in one bucket: still exact scores and full recall
    on planted pairs, with the hot bucket spread over many sub-blocks."""
    from textlake.operators.similarity import approx_top_k
    rng = np.random.default_rng(5)
    hot = np.abs(rng.standard_normal((300, 16)))          # all-positive: one bucket per table
    rest = rng.standard_normal((600, 16))
    store = np.vstack([hot, rest])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(store)],
                               "vec_id long, embedding array<float>")
    qs = spark.createDataFrame([(10_000 + i, [float(x) for x in store[i] * 1.001]) for i in range(0, 900, 45)],
                               "query_id long, embedding array<float>")
    got = approx_top_k(qs, df, 1, n_tables=2, n_bits=3,
                       params=Params(vector_block_bytes=16 * 8 * 20)).collect()
    assert {r.query_id: r.vec_id for r in got} == {10_000 + i: i for i in range(0, 900, 45)}


def test_string_ids_and_small_tiles(spark, monkeypatch):
    from textlake.operators import similarity as S
    rng = np.random.default_rng(1)
    vecs = rng.standard_normal((300, 8))
    df = spark.createDataFrame([(f"v{i:03d}", [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id string, embedding array<float>")
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    rows = {r.vec_id: r.embedding for r in df.collect()}
    want = brute(rows, rows, 4, True)
    for strategy, params in (("broadcast", Params()), ("blocks", Params(query_block_bytes=1000, block_group_bytes=8000))):
        got = {}
        for r in S.top_k_similar(q, df, 4, exclude_same_id=True, strategy=strategy, params=params).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want, strategy


def test_kernel_memory_is_tiled(monkeypatch):
    import tracemalloc

    from textlake.operators import similarity as S
    rng = np.random.default_rng(2)
    v, q = rng.standard_normal((60_000, 4)), rng.standard_normal((3000, 4))
    monkeypatch.setattr(S, "TILE_BYTES", 4 << 20)
    ids = np.arange(60_000)
    tracemalloc.start()
    out = S._score_block(ids, v, ids[:3000], q, 2, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20  # the whole score matrix would take 1.4 GB
    sim = v @ q[7]
    sim[7] = -np.inf
    assert out[out.query_id == 7].vec_id.tolist()[:2] == np.argsort(-sim)[:2].tolist()


def test_kernel_ties_and_repeated_ids(monkeypatch):
    """Any order of rows, any tile: the same rows, equal scores by ascending id."""
    from textlake.operators import similarity as S
    rng = np.random.default_rng(8)
    v = np.repeat(np.eye(4), 500, axis=0)  # many equal scores
    ids = np.append(rng.permutation(1990), [5] * 10)
    q, qids = np.eye(4)[:3], np.array([3, 5, -1])
    for tile in (32 << 20, 8 * 1024 * 300):
        monkeypatch.setattr(S, "TILE_BYTES", tile)
        out = S._score_block(ids, v, qids, q, 7, True)
        for i, x in enumerate(qids):
            want = sorted((-s, j) for s, j in zip(v @ q[i], ids) if j != x)[:7]
            got = out[out.query_id == x]
            assert [(-s, j) for s, j in zip(got.score, got.vec_id)] == want


def test_groups_are_small_and_many():
    from textlake.operators.similarity import MOST_TABLES, block_grid, plan_signatures
    nq, nv = block_grid(600_000, 600_000, 64, 512 << 20, 12)
    assert nq * nv >= 48 and (600_000 / nq + 600_000 / nv) * 64 * 8 * 4 <= 512 << 20
    assert block_grid(1, 1, 64, 512 << 20, 12) == (1, 1)
    # signatures never copy the vectors more than a few times
    assert MOST_TABLES <= 10 and plan_signatures(np.array([0.35]), np.ones(1), 600_000, 600_000)[1] <= MOST_TABLES


def test_signature_bits_grow_with_the_store():
    from textlake.operators.similarity import signature_bits
    assert [signature_bits(n) for n in (0, 256, 512, 1 << 18, 1 << 40)] == [1, 1, 1, 10, 24]


def test_approx_default_bits_recall(spark):
    from textlake.operators.similarity import approx_top_k
    rng = np.random.default_rng(4)
    base = rng.standard_normal((2000, 16))
    store = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<float>")
    qs = spark.createDataFrame([(5000 + i, [float(x) for x in base[i] + 0.05 * rng.standard_normal(16)]) for i in range(0, 2000, 20)],
                               "query_id long, embedding array<float>")
    got = {r.query_id: r.vec_id for r in approx_top_k(qs, store, 1).collect()}
    assert sum(got.get(5000 + i) == i for i in range(0, 2000, 20)) >= 95


def test_planned_recall_holds_at_every_size():
    from textlake.operators.similarity import expected_recall, plan_signatures
    one = np.ones(1)
    for cosine in (0.1, 0.35, 0.6, 0.8, 0.99):
        for n in (1, 2000, 1 << 18, 1 << 20, 1 << 30):
            for bits in (None, 3, 10):
                got = plan_signatures(np.array([cosine]), one, n, n, n_bits=bits)
                assert got == (0, 1) or expected_recall(np.array([cosine]), one, *got) >= 0.9
    assert plan_signatures(np.array([0.8]), one, 1 << 20, 1 << 20)[0] > 4  # still worth it
    assert plan_signatures(np.array([0.8]), one, 1 << 20, 1 << 20, n_tables=1) == (0, 1)
    assert plan_signatures(np.zeros(0), np.zeros(0), 0, 0) == (0, 1)


def recall_by_default(spark, vecs, n_queries, k=10):
    """Recall@k of the default settings against numpy brute force."""
    import pandas as pd

    from textlake.operators.similarity import approx_top_k
    vecs = (vecs / np.linalg.norm(vecs, axis=1, keepdims=True)).astype(np.float32)
    store = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(vecs)), "embedding": list(vecs)}),
                                  "vec_id long, embedding array<float>")
    q = store.where(F.col("vec_id") < n_queries).select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.vec_id) for r in approx_top_k(q, store, k, exclude_same_id=True).collect()}
    hit = 0
    for i in range(0, n_queries, 500):
        sim = vecs[i:min(i + 500, n_queries)] @ vecs.T
        sim[np.arange(len(sim)), np.arange(i, i + len(sim))] = -2
        hit += sum((i + a, int(b)) in got for a, row in enumerate(np.argpartition(-sim, k, axis=1)[:, :k]) for b in row)
    return hit / (n_queries * k)


def test_default_recall_on_a_larger_store_of_low_cosines(spark):
    vecs = np.random.default_rng(6).standard_normal((20_000, 64))
    assert recall_by_default(spark, vecs, 200) >= 0.9


def test_default_recall_by_signatures(spark, monkeypatch):
    from textlake.operators import similarity as S
    plans = []
    plan = S.plan_signatures
    monkeypatch.setattr(S, "plan_signatures", lambda *a: plans.append(plan(*a)) or plans[-1])
    monkeypatch.setattr(S, "COPY_COST", 1)
    rng = np.random.default_rng(7)
    vecs = np.repeat(rng.standard_normal((1200, 64)), 12, axis=0) + 0.5 * rng.standard_normal((14_400, 64))  # cosine 0.8
    assert recall_by_default(spark, vecs, 1000) >= 0.9
    assert plans[0][0] > 0


def test_retrieve_refuses_other_encoders(spark):
    import pytest

    from textlake.plans.retrieval import retrieve
    v = spark.createDataFrame([(1, [1.0, 0.0], "m1")], "vec_id long, embedding array<float>, model_id string")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding", F.lit("m2").alias("model_id"))
    with pytest.raises(ValueError):
        retrieve(q, v)
    assert retrieve(q.withColumn("model_id", F.lit("m1")), v).count() == 1
