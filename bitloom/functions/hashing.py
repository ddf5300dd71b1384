"""Column functions on content hashes; texts are joined by NUL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = chr(0)


def sha(*parts: Column | str) -> Column:
    """SHA-256, in hex, of the parts' texts joined by NUL. Hex sorts as the bytes do."""
    return F.sha2(F.concat_ws(NUL, *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary"), 256)


def chained(receipts: Column) -> Column:
    """sha(previous, receipt) over an ordered array of hex hashes, from 64 zeros on."""
    return F.aggregate(receipts, F.lit("0" * 64), lambda a, x: F.sha2(F.concat(a, x).cast("binary"), 256))


def unsigned_64(hexes: Column) -> Column:
    """The number that the first 16 hex digits are."""
    return F.conv(F.substring(hexes, 1, 16), 16, 10).cast("decimal(20,0)")
