"""Writers; Spark's commit protocol makes a finished write visible as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shards(df: DataFrame, path: str, key: str, n: int) -> None:
    """Parquet in `n` ranges of `key`, one folder each; rows are in order of `key` within a file."""
    ranged = df.repartitionByRange(n, key).sortWithinPartitions(key)
    ranged.withColumn("shard", F.spark_partition_id()).write.mode("overwrite").partitionBy("shard").parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def receipts(path_df: DataFrame, key: str) -> DataFrame:
    """(shard, n, first, last, digest) of written shards; the digest is a sum of row hashes, which no order of rows changes."""
    h = F.xxhash64(*[c for c in path_df.columns if c != "shard"]).cast("decimal(38,0)")
    return path_df.groupBy("shard").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"), F.sum(h).alias("digest"))


def unfinished(expected: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """What a resumed run still has to do: the expected cells that no receipt has."""
    return expected.join(done.select(*key).distinct(), list(key), "left_anti")
