"""Sinks (B1-B10): idempotent appends, upserts, mark tables.

No transactional table format is assumed. Idempotence comes from layout:

* :func:`append_new` -- exactly-once append: repeats inside the batch and
  rows whose key is already stored are removed before the append, so a
  replayed batch adds nothing.
* :class:`UpsertTable` -- a Parquet table partitioned by a hash of the key;
  a batch is merged with the partitions it touches and replaces those.
* :func:`write_marks` -- high-water marks as a small versioned table.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.session import materialize


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(p) if s.isDirectory())


def _touched(df: DataFrame, cols: list[str]) -> Column:
    """Filter for the partitions a batch touches: one value list per column.

    The values are partition folders of one batch, collected to the driver
    (as the file index itself is); NULL is a folder like any other.
    """
    cond = F.lit(True)
    for c in cols:
        values = [r[0] for r in df.select(c).distinct().collect()]
        known = [v for v in values if v is not None]
        one = F.col(c).isin(known) if known else F.lit(False)
        cond = cond & (one | F.col(c).isNull() if len(known) < len(values) else one)
    return cond


def append_new(df: DataFrame, path: str, key: list[str], partition_by: list[str] | None = None,
               fmt: str = "parquet") -> None:
    """Append only keys not yet stored (replay-safe).

    One row per key: repeats inside the batch are dropped too, and NULL is a
    key value like any other. With ``partition_by`` -- columns that depend on
    the key, such as its day -- only the partitions that the batch touches
    are read; without it the stored keys are.
    """
    spark = df.sparkSession
    new = df.dropDuplicates(key)
    if path_exists(spark, path):
        stored = spark.read.format(fmt).load(path)
        if partition_by:
            stored = stored.where(_touched(df, partition_by))
        stored = stored.select(*[F.col(k).alias(f"_s_{k}") for k in key])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in key])
        new = new.join(stored, same, "left_anti")
    w = new.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def overwrite_checked(df: DataFrame, path: str, vec: str, dim: int,
                      partition_by: list[str] | None = None) -> None:
    """Drop-and-recreate with an inline dimension check.

    The check lives inside the written vector column (``raise_error`` when
    the dimension differs), so it fails the job during the write with no
    extra pass -- and, unlike a separate check column, cannot be pruned.
    """
    checked = df.withColumn(vec, F.when(F.size(vec) == F.lit(dim), F.col(vec)).otherwise(
        F.raise_error(F.lit(f"vector dimension differs from {dim}"))))
    w = checked.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


#: Bytes of a folder of an upserted table; past twice that on average the folders double in number.
PART_BYTES = 64 << 20


class UpsertTable:
    """Parquet table, one row per key, partitioned by a hash of the key.

    A batch reads, merges and overwrites only the partitions that its keys
    fall in (dynamic partition overwrite), so writing it again changes
    nothing, and a batch of n keys rewrites n folders at most. With ``order``
    (a stored column, such as an event time) the row of the largest order
    wins, whatever order the batches come in; without it, and between equal
    orders, the batch wins over what is stored.

    The number of folders follows the table's bytes: it begins with ``parts``
    and doubles until folders hold ``part_bytes`` on average, so each row is
    moved a few times in all however the table grows. The folders of one
    number lie in ``parts=<number>``; a larger number is written whole before
    it counts, and the old one is deleted after that.

    Without ``order`` a batch of distinct keys that has all stored keys of its
    partitions (a first load, a replay) is written as it is: no rows are
    merged, and only the keys are compared.
    """

    PART = "key_part"

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: str | None = None, parts: int = 16,
                 part_bytes: int = PART_BYTES):
        self.spark, self.path, self.key, self.order, self.parts, self.part_bytes = spark, path, key, order, parts, part_bytes

    def _dir(self, parts: int) -> str:
        return os.path.join(self.path, f"parts={parts}")

    def current_parts(self) -> int | None:
        """The number of folders in use; None before the first batch."""
        found = sorted((int(d[6:]) for d in list_dirs(self.spark, self.path) if d.startswith("parts=")), reverse=True)
        return next((n for n in found if path_exists(self.spark, os.path.join(self._dir(n), "_SUCCESS"))), None)

    def _placed(self, df: DataFrame, parts: int) -> DataFrame:
        return df.withColumn(self.PART, F.pmod(F.xxhash64(*self.key), F.lit(parts)).cast("int"))

    def _save(self, rows: DataFrame, parts: int, how: str) -> None:
        rows.hint("rebalance", self.PART).write.mode("overwrite").option("partitionOverwriteMode", how) \
            .partitionBy(self.PART).parquet(self._dir(parts))

    def write_batch(self, df: DataFrame) -> None:
        """Merge one batch into the table; of a key's rows in the batch the last by ``order`` counts."""
        stored = self.current_parts()
        parts = stored or self.parts
        rows = self._placed(df, parts)
        table = self.spark.read.parquet(self._dir(parts)) if stored else None
        if self.order is None and self._replaces(rows, table):
            missing = [f for f in (table.schema if stored else []) if f.name not in rows.columns]
            rows = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
            self._save(rows, parts, "dynamic" if stored else "static")
            return self._grow(parts)
        rows = rows.withColumn("_new", F.lit(1))
        if stored:
            old = table.where(_touched(rows, [self.PART]))
            rows = rows.unionByName(old.withColumn("_new", F.lit(0)), allowMissingColumns=True)
        by = [F.col(self.order), F.col("_new")] if self.order else [F.col("_new")]
        values = [c for c in rows.columns if c not in (*self.key, self.PART)]
        rows = rows.groupBy(*self.key, self.PART).agg(F.max_by(F.struct(*values), F.struct(*by)).alias("_v"))
        rows = rows.select(*self.key, "_v.*", self.PART).drop("_new")
        if stored:  # stored before the table's own partitions are replaced
            self._save(materialize(rows), parts, "dynamic")
        else:
            self._save(rows, parts, "static")
        self._grow(parts)

    def _replaces(self, rows: DataFrame, table: DataFrame | None) -> bool:
        """Whether the batch has each key once and all stored keys of the partitions it touches.

        Then there is nothing to choose between, and only keys are read to know it.
        """
        keys = materialize(rows.select(*self.key, self.PART))
        if not keys.groupBy(*self.key).count().where("count > 1").isEmpty():
            return False
        if table is None:
            return True
        new = keys.select(*[F.col(k).alias(f"_n_{k}") for k in self.key])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in self.key])
        return table.where(_touched(keys, [self.PART])).select(*self.key).join(new, same, "left_anti").isEmpty()

    def _grow(self, parts: int) -> None:
        """Deal the rows to more folders once these hold twice their bytes, and delete folders out of use."""
        fs, p = _fs(self.spark, self._dir(parts))
        size, need = fs.getContentSummary(p).getLength(), parts
        if size > 2 * parts * self.part_bytes:
            while size > need * self.part_bytes:
                need *= 2
            self._save(self._placed(self.spark.read.parquet(self._dir(parts)), need), need, "static")
        for d in list_dirs(self.spark, self.path):
            if d.startswith("parts=") and d != f"parts={need}":
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, d)), True)

    def read(self) -> DataFrame:
        """The newest row of every key."""
        return self.spark.read.parquet(self._dir(self.current_parts())).drop(self.PART)


def write_marks(df: DataFrame, path: str, version: int) -> None:
    """One-row-per-source mark table, a new version per run."""
    df.write.mode("overwrite").parquet(os.path.join(path, f"v={int(version):012d}"))


def next_version(spark: SparkSession, path: str) -> int:
    """The version after the last complete or broken one."""
    found = [int(d[2:]) for d in list_dirs(spark, path) if d.startswith("v=")]
    return max(found, default=0) + 1


def read_marks(spark: SparkSession, path: str) -> DataFrame | None:
    """Latest complete version of the mark table."""
    versions = [d for d in list_dirs(spark, path) if d.startswith("v=")
                and path_exists(spark, os.path.join(path, d, "_SUCCESS"))]
    if not versions:
        return None
    return spark.read.parquet(os.path.join(path, versions[-1]))
