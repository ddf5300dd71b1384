"""Reading the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of `sf_dir`, through Spark's own reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
