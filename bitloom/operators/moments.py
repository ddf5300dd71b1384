"""A bank of codes as its moments: what gives the mean and variance of distances to it without a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bank_moments(bank: DataFrame, vector: Column, *by: str) -> DataFrame:
    """(by, n, bit_sum, gram): the number of codes, the sums of their bipolar bits, and of products of bits, row by row.

    Sums are partial in each task; a bank of any length ends as one row of B + B * B longs for each group.
    """
    v = bank.select(*by, vector.alias("v"))
    pairs = v.select(*by, "v", F.posexplode("v").alias("i", "x")).select(*by, "i", "x", F.posexplode("v").alias("j", "y"))
    cells = pairs.groupBy(*by, "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s"), F.sum("x").alias("sx"), F.count("*").alias("n"))
    rows = cells.groupBy(*by, "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "s"))), lambda z: z["s"]).alias("row"), F.first("sx").alias("sx"), F.first("n").alias("n"))
    whole = F.sort_array(F.collect_list(F.struct("i", "row", "sx")))
    return rows.groupBy(*by).agg(F.first("n").alias("n"), whole.alias("w")).select(*by, "n", F.transform("w", lambda z: z["sx"]).alias("bit_sum"), F.transform("w", lambda z: z["row"]).alias("gram"))


def radius_population(q: Column, n: Column, bit_sum: Column, gram: Column, bits: int) -> tuple[Column, Column]:
    """Exact mean and population variance of the distances of a bipolar code `q` to the bank, from integers alone."""
    times = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    qc = times(q, bit_sum)
    c2 = n * bits - qc
    q4 = n * bits * bits - 2 * bits * qc + times(q, F.transform(gram, lambda row: times(row, q)))
    mean = c2 / (2.0 * n)
    return mean, F.greatest(F.lit(0.0), (n * q4 - c2 * c2) / (4.0 * n * n))


def z_score(r: Column, mean: Column, variance: Column, degenerate: Column, bits: int) -> Column:
    """Higher is nearer: deviations below the bank's mean distance; -r / bits where either bank's distances are all equal."""
    return F.when(degenerate, -r / F.lit(float(bits))).otherwise((mean - r) / F.sqrt(variance))
