"""Harmonic and discount sums. Their tables are two short arrays that `with_series` puts beside every row as one broadcast row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Harmonic numbers up to here come from the table; discounts, which cut-offs bound, all do.
EXACT, MOST = 128, 1000
#: Fixed value: Euler's constant.
GAMMA = 0.5772156649015329


def with_series(df: DataFrame) -> DataFrame:
    """`df` with the tables, whatever its length: what `harmonic` and `discounts` read."""
    h, d = [0.0], [0.0]
    for j in range(1, EXACT + 1):
        h.append(h[-1] + 1 / j)
    for j in range(1, MOST + 1):
        d.append(d[-1] + 1 / math.log2(j + 1))
    one = df.sparkSession.createDataFrame([(h, d)], "harmonic_table array<double>, discount_table array<double>")
    return df.crossJoin(F.broadcast(one))


def without_series(df: DataFrame) -> DataFrame:
    return df.drop("harmonic_table", "discount_table")


def harmonic(a: Column) -> Column:
    """1 + 1/2 + ... + 1/a: from the table up to 128, by the asymptotic series beyond, which is then exact to 1e-15."""
    x = a.cast("double")
    far = F.log(x) + GAMMA + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(a <= EXACT, F.get(F.col("harmonic_table"), a.cast("int"))).otherwise(far)


def discounts(a: Column) -> Column:
    """Sum over j up to a of 1 / log2(j + 1); a is MOST at the utmost."""
    return F.get(F.col("discount_table"), F.least(a, F.lit(MOST)).cast("int"))
