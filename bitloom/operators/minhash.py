"""One-bit MinHash of label sets: a bit is the colour of the active label that the bit's permutation ranks first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha


def colour_map(labels: DataFrame, bits: int, seed: str = "20260822") -> DataFrame:
    """(bit, label, order, colour) for the distinct `label`s: the order of hashes is the permutation, their last digit the colour."""
    h = sha("minhash", seed, F.col("bit"), F.col("label"))
    each = labels.select("label").distinct().select("label", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit")).withColumn("order", h)
    return each.withColumn("colour", (F.conv(F.substring("order", 64, 1), 16, 10).cast("int") % 2).cast("int"))


def encode(items: DataFrame, labels: str, key: str, colours: DataFrame) -> DataFrame:
    """(key, sketch): the packed bits of each item's label set; items without a label are left out."""
    each = items.select(key, F.explode(labels).alias("label"))
    one = each.join(colours, "label").groupBy(key, "bit").agg(F.min_by("colour", "order").alias("colour"))
    return one.groupBy(key).agg(F.sum(F.when(F.col("colour") == 1, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).otherwise(0)).alias("sketch"))


def expected_mismatch(jaccard: Column, bits: int) -> Column:
    return F.lit(0.5 * bits) * (1 - jaccard)
