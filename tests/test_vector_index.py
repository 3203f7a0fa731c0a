"""Trained index: recall against the exact operator, pruned cells, additions without refitting."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.operators.similarity import top_k_similar
from textlake.operators.vector_index import VectorIndex

KIND = "vec_id long, embedding array<float>"


def frame(spark, mat, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(mat)], KIND)


def recall(spark, index, store, queries, k=10):
    q = queries.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id): r.score for r in top_k_similar(q, store, k, exclude_same_id=True).collect()}
    found = {(r.query_id, r.vec_id): r.score for r in index.search(q, k, exclude_same_id=True).collect()}
    assert all(abs(s - exact[p]) < 1e-9 for p, s in found.items() if p in exact)
    return len(exact.keys() & found.keys()) / len(exact)


def clustered(n, dim=32, groups=60, seed=5):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((groups, dim))[rng.integers(0, groups, n)] + 0.5 * rng.standard_normal((n, dim))


@pytest.mark.parametrize("size", [600, 4000])
def test_recall_and_pruning(spark, tmp_path, size):
    store = frame(spark, clustered(size))
    index = VectorIndex(spark, str(tmp_path / "ix"))
    index.build(store)
    centres, probes = index._centres()
    assert probes < len(centres)  # no query reads all cells
    assert recall(spark, index, store, store.where("vec_id % 20 = 0")) >= 0.9
    plan = index.probed([1, 2])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*cell#\d+ IN \(1,2\)", plan)
    assert index.probed([1]).count() < size / 2
    assert spark.read.parquet(str(tmp_path / "ix" / "vectors")).count() == size


def test_given_vectors(spark, tmp_path):
    store = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    index = VectorIndex(spark, str(tmp_path / "ix"))
    index.build(store)
    assert recall(spark, index, store, store.where("vec_id % 20 = 0")) >= 0.9


def test_additions_keep_the_cells(spark, tmp_path):
    mat = clustered(1500)
    first, later = frame(spark, mat[:1000]), frame(spark, mat[1000:], 1000)
    index = VectorIndex(spark, str(tmp_path / "ix"))
    index.build(first)
    cells = index._centres()[0]
    index.add(later)
    index.add(later)  # a replay changes nothing
    assert (index._centres()[0] == cells).all()
    store = first.unionByName(later)
    assert spark.read.parquet(str(tmp_path / "ix" / "vectors")).count() == 1500
    assert recall(spark, index, store, store.where("vec_id % 20 = 0")) >= 0.9


def test_odd_vectors_and_empty_store(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [0.6, 0.8]), (5, [0.6, 0.8]), (6, [])]
    store = spark.createDataFrame(rows, KIND)
    index = VectorIndex(spark, str(tmp_path / "ix"))
    index.build(store)
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 0.0]), (7, [1.0])], "query_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in index.search(q, 5, probes=9).collect()]
    assert sorted(got) == [(9, 1, 1), (9, 2, 5)]
    empty = VectorIndex(spark, str(tmp_path / "none"))
    empty.build(store.limit(0))
    assert empty.search(q, 5).collect() == []
