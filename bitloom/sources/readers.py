"""Readers with fixed schemas; what does not fit is an error or a counted violation, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settled


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): lines of text files, from 0; a line ends at \\n, \\r\\n or \\r, as a plain reader has it.

    Files are read in splits, and no line is moved: a first pass counts the lines of each split, sums over a file's splits say how many
    stand before, and a line's number is that and its place in its split. Splits are cut alike in both passes, as Spark cuts them by the
    files' sizes and the session's settings, which must not change between. An empty file has no lines.
    """
    file, at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")
    read = spark.read.text(path).select(file, at, "value").withColumn("k", F.monotonically_increasing_id())
    splits = settled(read.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("k").alias("first")))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split of a file
    splits = splits.select("file", "at", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    side = F.broadcast(splits) if splits.count() <= 1_000_000 else splits
    return read.join(side, ["file", "at"]).select("file", (F.col("k") + F.col("shift")).alias("line_no"), F.col("value").alias("line"))


def located(numbered: DataFrame, locators: DataFrame) -> DataFrame:
    """`locators` (file, line_no, ...) with the `line` that each points at; null where the file has no such line."""
    return locators.join(numbered.select("file", "line_no", "line"), ["file", "line_no"], "left")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of exactly this schema; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def event_log(spark: SparkSession, path: str, fields: str, names: list[str], digest: str = "sha256") -> DataFrame:
    """An event log with `valid`: whether each record's `digest` is the hash of its other fields as JSON in the order of `names`."""
    rows = jsonl(spark, path, f"{fields}, {digest} string")
    own = F.sha2(F.to_json(F.struct(*names)).cast("binary"), 256)
    return rows.withColumn("valid", F.col(digest).eqNullSafe(own))


def vector_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row_id string, vector array<float>").parquet(path)


def shard_violations(vectors: DataFrame, width: int) -> DataFrame:
    """Rows that a sealed shard may not have: null or repeated ids, null, ragged or not finite vectors, with the reason."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = F.when(F.col("row_id").isNull(), "no id").when(F.col("vector").isNull(), "no vector").when(F.size("vector") != width, "width").when(bad, "not finite")
    single = vectors.select("row_id", reason.alias("reason")).where("reason is not null")
    repeated = vectors.groupBy("row_id").count().where("count > 1 and row_id is not null").select("row_id", F.lit("repeated").alias("reason"))
    return single.unionAll(repeated)
