"""A trained vector index -- coarse cells, inverted lists, multi-probe search.

A bounded sample of the vectors gives unit centroids by spherical k-means. Each
vector is stored in the folder of its nearest cell (``vectors/cell=<n>``), so a
search reads the folders of the probed cells only. How many cells a query
probes is measured, not assumed: for ``PROBES`` vectors the exact neighbours are
found, and the number is the least with which ``RECALL`` of them lie in a
probed cell. New vectors go to the cells as they are; nothing is fitted again.

Scores are exact cosines; ties go by ascending id. Zero vectors, NULL vectors
and those of another dimension are neither stored nor answered, as in the exact
operator. A store without vectors answers nothing.

Bounds: the driver holds ``SAMPLE_ROWS`` vectors and ``MAX_CELLS`` centroids at
most, whatever the size of the store. Cells are cut into a grid of query parts
and vector parts by counted sizes, so a cell that holds a third of all vectors
is scored by many tasks.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from textlake.operators.similarity import _arrow_matrix, _block_scorer, _candidates, _id_type, top_k_similar
from textlake.params import Params
from textlake.sinks.tables import path_exists

#: Vectors that the cells are fitted on, at most.
SAMPLE_ROWS = 65_536
MAX_CELLS = 4096
#: Share of the exact neighbours that probed cells are to hold, above the 0.9 that is promised.
RECALL = 0.95
#: Vectors whose exact neighbours the number of probes is measured on.
PROBES = 128
_ROUNDS = 12


def fit_cells(sample: np.ndarray, n_cells: int, seed: int = 11) -> np.ndarray:
    """Unit centroids of spherical k-means over unit rows; a cell that loses all rows keeps its place."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(n_cells, len(sample)), replace=False)].copy()
    for _ in range(_ROUNDS):
        near = _ranked_cells(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def _ranked_cells(mat: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each row, nearest first; rows are handled in tiles."""
    out = np.zeros((len(mat), n), np.int32)
    rows = max(1, (8 << 20) // (8 * max(len(centres), 1)))
    for at in range(0, len(mat), rows):
        far = -(mat[at:at + rows] @ centres.T)
        out[at:at + rows] = np.argmin(far, axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]
    return out


def _assigner(centres, n: int):
    """Kernel: rows (id, vec, cells) of the vectors of the index's dimension that are not zero."""
    def run(batches):
        c = centres.value
        for b in batches:
            mat, ok = _arrow_matrix(b.column("vec"), b.num_rows, c.shape[1])
            if b.num_rows:
                cells = pa.array(list(_ranked_cells(mat, c, n)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), cells], ["id", "vec", "cells"]).filter(pa.array(ok))
    return run


class VectorIndex:
    """An index in the folder ``path``: ``cells`` (centroids and the number of probes) and ``vectors`` by cell."""

    def __init__(self, spark: SparkSession, path: str, vec_id: str = "vec_id", vec: str = "embedding", params: Params = Params()):
        self.spark, self.path, self.vec_id, self.vec, self.params = spark, path, vec_id, vec, params
        self._cells = os.path.join(path, "cells")
        self._vectors = os.path.join(path, "vectors")

    # -- building ---------------------------------------------------------------

    def _rows(self, df: DataFrame, key: str, values: str, dim: int | None = None) -> DataFrame:
        rows = df.select(F.col(key).cast(_id_type(df, key)).alias("id"), F.col(values).cast("array<float>").alias("vec"))
        return rows.where(F.size("vec") == dim) if dim is not None else rows.where(F.size("vec") > 0)

    def build(self, vectors: DataFrame, k: int = 10) -> None:
        """Fit the cells on a sample of ``vectors``, measure the probes for the best ``k``, and store all vectors."""
        rows = self._rows(vectors, self.vec_id, self.vec)
        dim, n = rows.agg(F.max(F.size("vec")), F.count("*")).first()
        if not n:
            return
        rows = rows.where(F.size("vec") == dim)
        # a hash of the id thins the rows before any of them moves
        share = min(1.0, 1.2 * SAMPLE_ROWS / n)
        sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(SAMPLE_ROWS).toArrow()
        mat, ok = _arrow_matrix(sample.column("vec"), sample.num_rows, dim)
        ids = sample.column("id").to_pylist()
        if not ok.any():
            return
        centres = fit_cells(mat[ok], int(min(MAX_CELLS, max(1, round(math.sqrt(n))))))
        picked = np.flatnonzero(ok)[:: max(1, int(ok.sum()) // PROBES)][:PROBES]
        probes = self._measure(rows, [ids[i] for i in picked], mat[picked], centres, k)
        cells = [(i, [float(x) for x in c], probes) for i, c in enumerate(centres)]
        self.spark.createDataFrame(cells, "cell int, centre array<double>, probes int").coalesce(1).write.parquet(self._cells)
        self.add(vectors)

    def _measure(self, rows: DataFrame, ids: list, mat: np.ndarray, centres: np.ndarray, k: int) -> int:
        """Cells to probe so that ``RECALL`` of the exact neighbours of some vectors are found."""
        kind = T.StructType([rows.schema["id"], rows.schema["vec"]])
        asked = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, mat)], kind)
        found = top_k_similar(asked, rows, k, query_id="id", query_vec="vec", vec_id="id", vec="vec", exclude_same_id=True,
                              params=self.params, strategy="broadcast")
        pairs = found.join(F.broadcast(rows.join(F.broadcast(found.select(F.col("vec_id").alias("id")).distinct()), "id")
                                       .select(F.col("id").alias("vec_id"), "vec")), "vec_id").select("query_id", "vec").toArrow()
        if not pairs.num_rows:
            return 1
        place = np.argsort(_ranked_cells(mat, centres, len(centres)), axis=1)  # rank of each cell for each query
        row = {i: r for r, i in enumerate(ids)}
        near = _ranked_cells(_arrow_matrix(pairs.column("vec"), pairs.num_rows, mat.shape[1])[0], centres, 1)[:, 0]
        ranks = np.sort(place[[row[q] for q in pairs.column("query_id").to_pylist()], near])
        return int(ranks[min(len(ranks) - 1, math.ceil(RECALL * len(ranks)) - 1)]) + 1

    def _centres(self) -> tuple[np.ndarray, int]:
        cells = self.spark.read.parquet(self._cells).orderBy("cell").collect()
        return np.array([r["centre"] for r in cells]), cells[0]["probes"]

    def add(self, vectors: DataFrame) -> None:
        """Store vectors whose id is not in their cell yet; the cells stay as they were fitted."""
        if not path_exists(self.spark, self._cells):
            return self.build(vectors)
        centres, _ = self._centres()
        rows = self._rows(vectors, self.vec_id, self.vec, centres.shape[1]).dropDuplicates(["id"])
        kind = T.StructType([rows.schema["id"], rows.schema["vec"], T.StructField("cells", T.ArrayType(T.IntegerType()))])
        rows = rows.mapInArrow(_assigner(self.spark.sparkContext.broadcast(centres), 1), kind).select("id", "vec", F.col("cells")[0].alias("cell"))
        if path_exists(self.spark, self._vectors):
            rows = rows.join(self.spark.read.parquet(self._vectors).select("id", "cell"), ["id", "cell"], "left_anti")
        # rebalanced by cell: small cells share a task, a large one is split over several files
        rows.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(self._vectors)

    # -- search -------------------------------------------------------------------

    def probed(self, cells: list[int]) -> DataFrame:
        """The stored vectors of some cells; other folders are not read."""
        return self.spark.read.parquet(self._vectors).where(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", query_vec: str = "embedding",
               probes: int | None = None, exclude_same_id: bool = False) -> DataFrame:
        """Rows (query_id, rank, vec_id, score): the best ``k`` of the probed cells for each query."""
        kinds = T.StructType([T.StructField("query_id", _id_type(queries, query_id)), T.StructField("rank", T.LongType()),
                              T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
        if not path_exists(self.spark, self._vectors):
            return self.spark.createDataFrame([], kinds)
        centres, measured = self._centres()
        probes = min(probes or measured, len(centres))
        dim = centres.shape[1]
        q = self._rows(queries, query_id, query_vec, dim)
        kind = T.StructType([q.schema["id"], q.schema["vec"], T.StructField("cells", T.ArrayType(T.IntegerType()))])
        q = q.mapInArrow(_assigner(self.spark.sparkContext.broadcast(centres), probes), kind).select(
            F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.explode("cells").alias("cell"))
        wanted = [r[0] for r in q.select("cell").distinct().collect()]  # MAX_CELLS numbers at most
        v = self.probed(wanted).select(F.col("id").alias("vid"), "vec", "cell")
        rows_per_part = max(1, self.params.vector_block_bytes // (8 * dim))
        size = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / rows_per_part).cast("int").alias(name))
        grid = F.broadcast(size(v, "n_v").join(size(q, "n_q"), "cell"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
        v = v.join(grid, "cell").withColumn("v_part", own("vid", "n_v")).withColumn("q_part", every("n_q"))
        q = q.join(grid, "cell").withColumn("q_part", own("qid", "n_q")).withColumn("v_part", every("n_v"))
        keys = ["cell", "q_part", "v_part"]
        schema = _candidates(q, "qid", v, "vid")
        found = q.select("qid", "qvec", *keys).groupBy(*keys).cogroup(v.select("vid", "vec", *keys).groupBy(*keys)) \
            .applyInArrow(_block_scorer(k, dim, exclude_same_id, to_arrow_schema(schema)), schema)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
        return (found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))
