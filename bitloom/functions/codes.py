"""Column functions on bipolar codes: signs, packed bits, Hamming distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTHS = (16, 32, 64)


def bipolar(vector: Column) -> Column:
    """Signs of a vector as -1 and 1; zero counts as positive."""
    return F.transform(vector, lambda x: F.when(x >= 0, F.lit(1)).otherwise(F.lit(-1)))


def pack(vector: Column, first: int = 0, bits: int | None = None) -> Column:
    """Bit i of a long is set where element first + i is 0 or more."""
    own = F.slice(vector, first + 1, bits) if bits is not None else vector
    return F.aggregate(F.transform(own, lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def steps(vector: Column) -> Column:
    """Each element less the next, the last less the first: what the upper half of 64-bit codes is made of."""
    return F.transform(vector, lambda x, i: x.cast("double") - F.get(vector, (i + 1) % F.size(vector)).cast("double"))


def code(vector: Column, bits: int) -> Column:
    """16: the first 16 signs; 32: all 32 signs; 64: those, then the signs of the steps."""
    if bits < 64:
        return pack(vector, 0, bits)
    return pack(vector).bitwiseOR(F.shiftleft(pack(steps(vector)), 32))


def unpack(value: Column, bits: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(F.getbit(value.cast("long"), i) == 1, F.lit(1)).otherwise(F.lit(-1)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hamming_by_difference(a: Column, b: Column) -> Column:
    """Differing entries of two bipolar arrays."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda z: z))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hamming_by_product(a: Column, b: Column, bits: int) -> Column:
    return ((F.lit(bits) - dot(a, b)) / 2).cast("int")


def norm(a: Column, least: float = 1e-8) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(least))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalized(a: Column) -> Column:
    """The vector over its length, which counts as 1e-8 at least."""
    length = norm(a)
    return F.transform(a, lambda x: x.cast("double") / length)
