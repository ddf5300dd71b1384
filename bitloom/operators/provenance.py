"""Hash chains, Merkle roots and contiguity over tables of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import chained


def merkle_levels(leaves: DataFrame, key: str = "i", most: int = 64) -> DataFrame:
    """(root): of hex hashes numbered from 0 without holes; pairs are hashed together, an odd last one with itself.

    A level is one aggregation by half the number and has half the rows, so the levels' work sums to twice the first's.
    """
    now = leaves.select(F.col(key).cast("long").alias("i"), F.col("h"))
    n = now.count()
    while n > 1 and most:
        pairs = now.groupBy(F.expr("i div 2").alias("i")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"))
        now = pairs.select("i", F.sha2(F.concat("a", "b").cast("binary"), 256).alias("h"))
        n, most = (n + 1) // 2, most - 1
        if n > 1 and most % 8 == 0:
            now = now.repartition(max(1, n // 1_000_000), "i")
    return now.select(F.col("h").alias("root"))


def chains(rows: DataFrame, by: list[str], order: str, receipt: Column, weight: str | None = None) -> DataFrame:
    """(by, n, last) and, with `weight`, total: a hash chain over each group's receipts in order, and sums.

    `by` is to name chunks, which writers bound; chunks are chained by a second call over their last hashes.
    """
    own = rows.select(*by, order, receipt.alias("receipt"), *([weight] if weight else []))
    sums = [F.sum(weight).alias("total")] if weight else []
    g = own.groupBy(*by).agg(F.count("*").alias("n"), *sums, F.transform(F.sort_array(F.collect_list(F.struct(order, "receipt"))), lambda x: x["receipt"]).alias("all"))
    return g.select(*by, "n", *(["total"] if weight else []), chained(F.col("all")).alias("last"))


def holes(rows: DataFrame, by: str, number: str) -> DataFrame:
    """(by, previous, number): where a number doesn't follow its predecessor by one."""
    w = Window.partitionBy(by).orderBy(number)
    return rows.select(by, F.lag(number).over(w).alias("previous"), number).where(F.col("previous").isNotNull() & (F.col(number) != F.col("previous") + 1))
