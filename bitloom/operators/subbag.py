"""Random subsets of rows for several heads: whether a head has an id follows from a hash of both, so order and partitions don't matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.hashing import sha

VERSION = "subbag-v1"


def threshold(keep: float) -> str:
    """The 16 hex digits below which a share `keep` of all hashes lies."""
    return f"{min(int(keep * (1 << 64)), (1 << 64) - 1):016x}"


def subbag(ids: Column, heads: int = 4, keep: float = 0.8, seed: int = 17) -> Column:
    """The heads of each id as bits of a number; an id that no head draws goes to the head of its least hash, so that none is lost."""
    hashes = [F.substring(sha(VERSION, str(seed), str(h), ids), 1, 16) for h in range(heads)]
    drawn = F.lit(0).cast("long")
    for h, x in enumerate(hashes):
        drawn = drawn + F.when(x < threshold(keep), F.lit(1 << h)).otherwise(F.lit(0))
    least = F.least(*hashes) if heads > 1 else hashes[0]
    one = F.lit(0)
    for h in reversed(range(heads)):
        one = F.when(hashes[h] == least, F.lit(1 << h)).otherwise(one)
    return F.when(drawn > 0, drawn).otherwise(one.cast("long"))
