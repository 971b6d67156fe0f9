"""Named Parquet tables under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """`folder`/`name`.parquet, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
