"""Sums of doubles that no order of rows changes.

A double is an integer of at most 55 bits times a power of two. Integers of equal power are added as decimals, which is exact and
commutes, so Spark combines them in part before rows meet; a group has at most some 2,100 powers. What they add up to is rounded once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Powers of NaN and of the infinities, which no finite double has.
_NAN, _PLUS, _MINUS = 9999, 9998, 9997


def parts(x: Column) -> tuple[Column, Column]:
    """(power, integer) with x = integer * 2**power; the integer is exact as a long. Not for nulls, NaN and infinities."""
    power = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log2(F.abs(x))).cast("int") - 53)  # one bit to spare, should the logarithm be off
    up = -power
    half = F.floor(up / 2)
    return power, (x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), up - half)).cast("long")


def _rounded(sums: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for bins, counts in sums:
        out = []
        for own, n in zip(bins, counts):
            powers = {r["power"] for r in own}
            if _NAN in powers or {_PLUS, _MINUS} <= powers:
                out.append((math.nan, math.nan, math.nan))
            elif powers & {_PLUS, _MINUS}:
                x = math.inf if _PLUS in powers else -math.inf
                out.append((x, x, 0.0))
            elif not n:
                out.append((None, None, None))
            else:
                low = min(powers)
                whole = Fraction(sum(int(r["integer"]) << (r["power"] - low) for r in own)) * Fraction(2) ** low
                try:
                    total = float(whole)
                except OverflowError:
                    total = math.inf if whole > 0 else -math.inf
                error = math.inf if math.isinf(total) else float(abs(whole - Fraction(total)))
                out.append((total, float(whole / int(n)), error))
        yield pd.DataFrame(out, columns=["total", "mean", "error"], dtype=object).astype(float)


def exact_sums(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by, name, n, total, mean, error) for each column of `values`: its sum and mean, each the double nearest to the exact one.

    error: how far `total` is from the exact sum, itself rounded. Nulls are left out; of nothing but nulls n is 0 and the rest null. A
    NaN, or both infinities, give NaN. Results are the same bits however rows are ordered and dealt. A key with a third of the rows is
    combined before rows meet, to a row for each power.
    """
    long = F.array(*(F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("x")) for v in values))
    rows = df.select(*by, F.explode(long).alias("v")).select(*by, "v.name", "v.x")
    power, integer = parts(F.col("x"))
    odd = F.when(F.isnan("x"), _NAN).when(F.col("x") == math.inf, _PLUS).when(F.col("x") == -math.inf, _MINUS)
    finite = F.col("x").isNotNull() & odd.isNull()
    rows = rows.select(*by, "name", F.col("x").isNotNull().cast("long").alias("one"), F.when(finite, power).otherwise(F.coalesce(odd, F.lit(0))).alias("power"), F.when(finite, integer).otherwise(F.lit(0).cast("long")).alias("integer"))
    bins = rows.groupBy(*by, "name", "power").agg(F.sum(F.col("integer").cast("decimal(28,0)")).alias("integer"), F.sum("one").alias("one"))
    sums = bins.groupBy(*by, "name").agg(F.collect_list(F.struct("power", "integer")).alias("bins"), F.sum("one").alias("n"))
    rounded = F.pandas_udf(_rounded, "total double, mean double, error double")
    out = sums.withColumn("r", rounded("bins", "n"))
    has = lambda p: F.exists("bins", lambda b: b["power"] == p)
    nan = has(_NAN) | (has(_PLUS) & has(_MINUS))  # pandas would make it a null
    bare = lambda c: F.when(nan, F.lit(math.nan)).when(F.col("n") > 0, F.col(f"r.{c}")).alias(c)
    return out.select(*by, "name", "n", *map(bare, ("total", "mean", "error")))


def unit_sums(x: Column, times: Column) -> tuple[Column, Column]:
    """Two sums of longs that hold the sum of `x` (0 to 1) counted `times` times to 60 bits after the point; `unit_total` reads them."""
    scale = F.lit(float(1 << 30))
    high = F.floor(x * scale)
    return F.sum(high.cast("long") * times), F.sum(((x * scale - high) * scale).cast("long") * times)


def unit_total(high: Column, low: Column) -> Column:
    whole = high.cast("decimal(20,0)") * F.lit(1 << 30).cast("decimal(10,0)") + low.cast("decimal(20,0)")
    return whole.cast("double") / F.lit(float(1 << 60))


def compensated(terms: Column) -> Column:
    """The sum of an array, with what each addition loses added at the end (Neumaier)."""

    def add(a: Column, x: Column) -> Column:
        t = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(terms, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), add, lambda a: a["s"] + a["c"])


def ordered_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], terms: dict[str, Column], first: Sequence[str] = ()) -> DataFrame:
    """(by, first, terms) of a table with few rows for each `by`: sums in the order of `order`, compensated, hence the same bits always."""
    row = F.struct(*order, *(t.cast("double").alias(f"__{n}") for n, t in terms.items()))
    rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("__rows"), *(F.first(c).alias(c) for c in first))
    return rows.select(*by, *first, *(compensated(F.col(f"__rows.__{n}")).alias(n) for n in terms))
