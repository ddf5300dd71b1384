"""The exact k nearest codes of each query, without all pairs: multi-index hashing.

A code is cut into parts of 16 bits. Of two codes within m (s + 1) - 1 bits, m parts, some part differs by s bits at most, so that
equality joins on a part with up to s bits struck find the pair. The radius s grows for those queries alone whose k-th distance is not yet
proved (Norouzi, Punjani and Fleet, 2012). A pair comes out of one join only: that of the first of its nearest parts, in that radius.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import hamming
from ..session import settled
from .rank import against_all

PART = 16
#: Bits of a part that are struck at most: 1,820 probes a part for the last one. Queries that are still open pass through all codes.
FLIPS = 4


def _part(code: Column, p: int) -> Column:
    return F.shiftrightunsigned(code, PART * p).bitwiseAND(F.lit((1 << PART) - 1).cast("long"))


def _masks(s: int) -> list[int]:
    return [sum(1 << b for b in bits) for bits in combinations(range(PART), s)]


def _parts(code: Column, width: Column) -> Column:
    return F.posexplode(F.slice(F.array(*(_part(code, p) for p in range(64 // PART))), F.lit(1), (width / PART).cast("int")))


def _probed(open_: DataFrame, cells: DataFrame, by: Sequence[str], width: Column, s: int) -> DataFrame:
    """The pairs of an open query and a cell whose nearest parts differ by s bits, once each."""
    own = cells.select(*by, "code", "n", _parts(F.col("code"), width).alias("part", "value"))
    asked = open_.select(*by, "qcode", _parts(F.col("qcode"), width).alias("part", "own"))
    asked = asked.select(*by, "qcode", "part", F.col("own"), F.explode(F.lit(_masks(s))).alias("mask")).withColumn("value", F.col("own").bitwiseXOR(F.col("mask").cast("long"))).drop("own", "mask")
    apart = [hamming(_part(F.col("qcode"), p), _part(F.col("code"), p)) for p in range(64 // PART)]
    later = reduce(lambda a, b: a & b, ((F.lit(p * PART) >= width) | F.when(F.col("part") > p, apart[p] > s).otherwise(apart[p] >= s) for p in range(64 // PART)))
    return asked.join(own, [*by, "part", "value"]).where(later).select(*by, "qcode", "code", "n", hamming(F.col("qcode"), F.col("code")).alias("r"))


def _reach(found: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """(by, qcode, reach): the distance within which `found` has k rows, where it has; from at most 65 counts a query."""
    counts = found.groupBy(*by, "qcode", "r").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by, "qcode").orderBy("r"))
    return counts.withColumn("upto", upto).where(F.col("upto") >= k).groupBy(*by, "qcode").agg(F.min("r").alias("reach"))


def nearest_codes(queries: DataFrame, gallery: DataFrame, k: int, bits: int | str, by: Sequence[str] = (), flips: int = FLIPS) -> DataFrame:
    """(by, qcode, code, n, r): of each distinct code `qcode` of `queries`, the codes `code` of `gallery` up to the distance of the k-th row.

    `by` are columns that have to be equal. n: rows of `gallery` with that code; all that are as far as the k-th row belong to the result,
    and where there are fewer than k rows all of them. Equal codes are one cell, so that a code that many rows share costs as one; a
    null code has no distance and is left out. bits: 16, 32, 48 or 64, or the column of `by` that says which, so that several widths take
    their rounds together. Each radius is checkpointed. `flips` chooses a way, not a result.
    """
    if bits not in (*range(PART, 65, PART), *by):
        raise ValueError(f"bits have to be 16, 32, 48 or 64 or a column of by, not {bits}")
    width = F.col(bits) if isinstance(bits, str) else F.lit(bits)
    cells = settled(gallery.where("code is not null").groupBy(*by, "code").agg(F.count("*").alias("n")))
    left = settled(queries.where("qcode is not null").select(*by, "qcode").distinct())
    some, done = None, []
    for s in range(flips + 1):
        n = left.count()
        if not n and done:
            break
        now = _probed(left, cells, by, width, s)
        now = now if some is None else now.unionByName(some.join(left, [*by, "qcode"], "left_semi"))
        met = settled(now)
        reach = _reach(met, by, k)
        near = met.join(reach, [*by, "qcode"], "left").where("reach is null or r <= reach")  # what is farther cannot be among the nearest
        proved = F.coalesce(F.col("reach") <= width / PART * (s + 1) - 1, F.lit(False))
        done.append(near.where(proved).drop("reach"))
        some = near.where(~proved).drop("reach")
        left = settled(left.join(reach.where(proved), [*by, "qcode"], "left_anti"))
    if left.count():  # the radius is too wide for probes: these pass through the cells
        one = cells.select(*(F.col(c).alias(f"__{c}") for c in by), "code", "n")
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by)) if by else None
        rest = against_all(left, one, "qcode", same).withColumn("r", hamming(F.col("qcode"), F.col("code"))).select(*by, "qcode", "code", "n", "r")
        reach = _reach(rest, by, k)
        done.append(rest.join(reach, [*by, "qcode"], "left").where("reach is null or r <= reach").drop("reach"))
    return reduce(DataFrame.unionByName, done)


def nearest(queries: DataFrame, gallery: DataFrame, k: int, bits: int | str, by: Sequence[str] = (), flips: int = FLIPS) -> DataFrame:
    """Each row of `queries` (by, qcode, ...) with the rows of `gallery` (by, code, ...) up to its k-th distance r, ties at the edge included."""
    near = nearest_codes(queries, gallery, k, bits, by, flips).drop("n")
    return queries.join(near, [*by, "qcode"]).join(gallery, [*by, "code"])
