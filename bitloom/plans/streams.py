"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import acks, chunks, windows
from .registry import query


@query("SELECT event_type, ts::DATE AS day, count(*) AS n, sum(round(value * 1000000)::BIGINT)::BIGINT AS micro, max(value) AS high FROM events GROUP BY ALL")
def stream_totals(spark, sf_dir):
    folder = chunks.shared_folder(spark)
    chunks.evaluate(spark, f"{sf_dir.rstrip('/')}/events*.parquet", folder)
    return chunks.totals(spark, folder)


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


@query(
    "WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, sha256(o_orderkey || ':' || o_orderstatus) AS receipt FROM orders), "
    "s AS (SELECT * FROM o WHERE NOT (o_custkey % 5 = 0 AND i = 2)), per AS (SELECT o_custkey, count(*) AS n, sum((o_orderkey % 7 = 0)::INTEGER) AS twice, "
    "CASE WHEN o_custkey % 5 = 0 THEN least(2, count(*)) ELSE count(*) END AS released FROM s GROUP BY o_custkey) "
    "SELECT o_custkey::VARCHAR AS cell, released::BIGINT AS released, (n - released)::BIGINT AS waiting, twice::BIGINT AS repeated, "
    "list_reduce(list_prepend(repeat('0', 64), (SELECT list(receipt ORDER BY i) FROM s WHERE s.o_custkey = per.o_custkey AND i < released)), lambda a, b: sha256(a || b)) AS chain FROM per"
)
def acknowledged_chunks(spark, sf_dir):
    """Each customer's orders as chunks that arrive out of order: every seventh comes twice, and each fifth customer's third never does."""
    o = table(spark, sf_dir, "orders")
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    receipt = F.sha2(F.concat_ws(":", "o_orderkey", "o_orderstatus"), 256)
    sent = o.select("o_custkey", "o_orderkey", i.cast("long").alias("ordinal"), receipt.alias("receipt")).where("not (o_custkey % 5 = 0 and ordinal = 2)")
    twice = sent.select("*", F.explode(F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    folder = chunks.shared_folder(spark)
    files = spark.sparkContext.defaultParallelism  # of each of three batches
    dealt = twice.repartition(3 * files, F.xxhash64("o_orderkey", "copy"))
    dealt.select(F.col("o_custkey").cast("string").alias("cell"), "ordinal", "receipt").write.parquet(f"{folder}/sent")
    acks.run(spark, f"{folder}/sent", folder, files)
    return acks.frontiers(acks.events(spark, folder))


@query(
    "WITH d AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, sum(round(value * 1000000)::BIGINT)::BIGINT AS micro FROM events GROUP BY 1, 2) "
    "SELECT * FROM d WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR"
)
def closed_windows(spark, sf_dir):
    """Days of events as a stream in order of time: those that the watermark, six hours behind the latest event, has closed."""
    folder = chunks.shared_folder(spark)
    e = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{folder}/in")
    windows.run(spark, f"{folder}/in", folder, "6 hours", 4, "1 day")
    return windows.closed(spark, folder)
