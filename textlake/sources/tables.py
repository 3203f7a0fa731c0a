"""Table scans with declared schemas (projection and filters reach parquet)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from textlake.schemas import TABLES


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = TABLES.get(name)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


class Tables:
    """Lazy accessor: ``Tables(spark, dir).documents`` etc."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)
