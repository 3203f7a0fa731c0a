"""File sources."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlake.sinks.tables import path_exists


def list_files(spark: SparkSession, folder: str, suffix: str = ".csv") -> DataFrame:
    """A1: names of the files of a folder with a suffix (a distributed listing
    through the file source; nothing is read into the driver)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder) \
        .select(F.col("path"))
    return df.select(F.element_at(F.split("path", "/"), -1).alias("file_name"))


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """A2: one row per file, its UTF-8 text and length."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"),
                     F.char_length("value").cast("long").alias("n_chars"))


CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A3: many CSV files in one scan with a declared schema; multi-line text
    fields round-trip."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).option("pathGlobFilter", "*.csv") \
        .csv(path)


def read_year_folders(spark: SparkSession, root: str, prefix: str = "boe_", fmt: str = "parquet",
                      schema: T.StructType | None = None) -> DataFrame:
    """A4: only ``{prefix}YYYY`` folders; the year comes from the path.

    With Hive-style ``year=YYYY`` folders (``prefix='year='``) partition
    pruning applies to filters on ``year``.
    """
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if prefix == "year=":
        return r.load(root)
    df = r.load(os.path.join(root, f"{prefix}*"))
    return df.withColumn("year", F.regexp_extract(F.col("_metadata.file_path"),
                                                  f"{prefix}(\\d{{4}})", 1).cast("int"))


def resolve_paths(spark: SparkSession, names: list[str], local_root: str,
                  remote_root: str) -> tuple[list[str], list[str]]:
    """A5: each file from the primary location if present, else the fallback.

    Returns ``(paths, missing)``: names found in neither place are reported
    and skipped, as the reference skipped a failing file. Only existence
    checks run on the driver; the transfer is the file system connector's
    job, and files that vanish after listing are skipped by the reader
    (``ignoreMissingFiles`` / ``ignoreCorruptFiles``).
    """
    paths, missing = [], []
    for n in names:
        local, remote = os.path.join(local_root, n), os.path.join(remote_root, n)
        if path_exists(spark, local):
            paths.append(local)
        elif path_exists(spark, remote):
            paths.append(remote)
        else:
            missing.append(n)
    return paths, missing


def read_many(spark: SparkSession, paths: list[str], schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).option("ignoreMissingFiles", "true") \
        .option("ignoreCorruptFiles", "true").load(paths)


def table_column(spark: SparkSession, table: str, column: str) -> DataFrame | None:
    """A10: one column of a catalog table when the table exists, else None."""
    if not spark.catalog.tableExists(table):
        return None
    return spark.table(table).select(column)


def read_link_set(spark: SparkSession, path: str) -> DataFrame:
    """A stored link set (distinct)."""
    return spark.read.parquet(path).distinct()
