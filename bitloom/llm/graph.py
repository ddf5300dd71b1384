"""Connected components over an edge table, in Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CROWD, join_unevenly, settle


def _stars(edges: DataFrame, large: bool, crowd: int) -> DataFrame:
    """One large-star or small-star step: links each node's neighbours above it (or itself and those below) to the least of them.

    Nodes with over `crowd` neighbours, of which there are few, are joined apart: their neighbours stay where they are.
    """
    pairs = edges.union(edges.select("v", "u")) if large else edges
    first = F.least(F.min("v"), F.first("u")) if large else F.min("v")
    least = pairs.groupBy("u").agg(first.alias("m"), F.count("*").alias("times"))
    met = join_unevenly(pairs, least, "u", "times", crowd)
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most: int = 60, crowd: int = CROWD) -> DataFrame:
    """(node, root) for each node of `edges` (u, v: long) but the roots: root is the least node reachable.

    Alternates large-star and small-star steps (Kiveris and others, 2014) until nothing changes; each round is checkpointed, so a
    lost executor costs one round at most. Nulls and loops link nothing.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = settle(edges)
    before = None
    for _ in range(most):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        edges = settle(_stars(_stars(edges, True, crowd), False, crowd))
    raise RuntimeError(f"components not settled after {most} rounds")
