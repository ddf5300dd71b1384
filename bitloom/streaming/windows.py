"""Windows of event time over a stream, with a watermark: what a window counts, and what came too late for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(stream: DataFrame, late: str, length: str = "1 hour") -> DataFrame:
    """(event_type, start, n, micro) of each window that the watermark has passed: `late` behind the latest event of earlier batches.

    Events that come after that are dropped by Spark, whose `numRowsDroppedByWatermark` counts them. State is one row for a type and window
    that is still open.
    """
    w = F.window("ts", length).alias("w")
    return stream.withWatermark("ts", late).groupBy("event_type", w).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 1_000_000).cast("long")).alias("micro")).select("event_type", F.col("w.start").alias("start"), "n", "micro")


def run(spark: SparkSession, path: str, folder: str, late: str, files: int = 1, length: str = "1 hour") -> int:
    """Takes in the events below `path`, `files` files to a batch in the order they were written, and leaves closed windows in `folder`.

    Returns how many rows came too late. Windows that are still open when the files end stay in the state for a later run.
    """
    source = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", files).parquet(path)
    out = windowed(source, late, length).writeStream.format("parquet").option("path", f"{folder}/windows").option("checkpointLocation", f"{folder}/offsets").outputMode("append")
    query = out.trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def closed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("event_type string, start timestamp, n long, micro long").parquet(f"{folder}/windows")
