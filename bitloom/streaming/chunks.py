"""Chunked evaluation as a stream: each micro-batch leaves its partial sums under its number, and a reader adds them up.

The sums of a batch are written over whatever an earlier attempt at the same batch left, and offsets advance only after that: a run that
is stopped and started again with the same folder neither loses nor repeats a chunk.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root

_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own below the one that the cluster shares."""
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def evaluate(spark: SparkSession, path: str, folder: str, files: int = 4) -> None:
    """Takes in what `path` has and has not been taken in before, `files` files to a chunk, then stops."""
    source = spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)

    def publish(batch: DataFrame, number: int) -> None:
        part = batch.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 1_000_000).cast("long")).alias("micro"), F.max("value").alias("high"))
        part.write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    stream = source.writeStream.foreachBatch(publish).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    stream.awaitTermination()


def totals(spark: SparkSession, folder: str) -> DataFrame:
    parts = spark.read.schema("event_type string, day date, n long, micro long, high double, batch int").parquet(f"{folder}/parts")
    return parts.groupBy("event_type", "day").agg(F.sum("n").alias("n"), F.sum("micro").alias("micro"), F.max("high").alias("high"))
