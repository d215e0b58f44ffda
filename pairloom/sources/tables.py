"""Table registry: named parquet tables below one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` (a file or a folder of part files) below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")
