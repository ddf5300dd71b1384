"""Prototype codes for labels, kept bits, and strictly falling score tables: small tables, made where the job is set up."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prototypes(n: int, bits: int) -> list[int]:
    """n codes of `bits` bits, far apart: rows of a Sylvester-Hadamard matrix and their complements, cut to the width.

    Row i of the matrix has bit j set where i and j share an odd number of ones, so any two rows differ in half of all bits before the
    cut. Rows are taken farthest first: each next one is that whose nearest taken row is farthest, ties to the least number.
    """
    size = 1 << max(bits - 1, n // 2, 1).bit_length()
    rows = np.bitwise_count(np.arange(1, size)[:, None] & np.arange(bits)) & 1
    pool = np.unique(np.concatenate([rows, 1 - rows]), axis=0)
    if len(pool) < n:
        raise ValueError(f"{bits} bits give {len(pool)} codes, not {n}")
    taken = [0]
    near = (pool != pool[0]).sum(axis=1)
    while len(taken) < n:
        taken.append(int(near.argmax()))
        near = np.minimum(near, (pool != pool[taken[-1]]).sum(axis=1))
    return [sum(1 << j for j in range(bits) if pool[i, j]) for i in taken]


def strict_table(scores: np.ndarray) -> np.ndarray:
    """Falling scores as floats that still fall: one that rounding would make equal becomes the next lower float."""
    out = scores.astype(np.float32)
    for i in range(1, len(out)):
        out[i] = min(out[i], np.nextafter(out[i - 1], np.float32(-np.inf)))
    return out


def kept_bits(statistics: DataFrame, k: int, score: str = "score") -> DataFrame:
    """(bit, place) of the k bits with the greatest score, ties to the lesser bit."""
    top = statistics.orderBy(F.desc(score), "bit").limit(k)
    return top.select("bit", F.col(score)).agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), "bit"))).alias("a")).select(F.posexplode("a").alias("place", "x")).select(F.col("x.bit").alias("bit"), "place")


def restrict(code: Column, bits: list[int]) -> Column:
    """A code of the given bits alone, the first lowest."""
    one = F.lit(0).cast("long")
    for place, bit in enumerate(bits):
        one = one.bitwiseOR(F.shiftleft(F.shiftright(code, bit).bitwiseAND(F.lit(1).cast("long")), place))
    return one
