"""What training codes would minimise, as figures over all pairs or triplets, from histograms alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    """ln(1 + exp x), without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def smooth_l1(x: Column, beta: float) -> Column:
    """Quadratic up to `beta`, linear beyond."""
    return F.when(F.abs(x) < beta, x * x / (2 * beta)).otherwise(F.abs(x) - beta / 2)


def pair_losses(counts: DataFrame, scale: float = 5.0, beta: float = 0.1, keys: Sequence[str] = ("direction", "bits")) -> DataFrame:
    """(keys, n_pairs, positive_share, logistic, graded, mse) of `rank.graded_counts`.

    With s the cosine of two codes, 1 - 2 r / bits: `logistic` is softplus(-scale s) over pairs with a common label and softplus(scale s)
    over the others, `graded` the smooth L1 distance of (s + 1) / 2 to the label sets' Jaccard; both are means of the two kinds' means, or
    of the kind there is. `mse` is the plain mean of that distance squared. No pairs: no rows.
    """
    s = 1 - 2 * F.col("r") / F.col("bits")
    off = (s + 1) / 2 - F.col("gain")
    same, n = F.col("gain") > 0, F.col("n")
    mean = lambda x, on: F.sum(F.when(on, x * n)) / F.sum(F.when(on, n))
    both = lambda a, b: (F.coalesce(a, b) + F.coalesce(b, a)) / 2
    graded = smooth_l1(off, beta)
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("n_pairs"), (F.sum(F.when(same, n).otherwise(0)) / F.sum("n")).alias("positive_share"),
        both(mean(softplus(-scale * s), same), mean(softplus(scale * s), ~same)).alias("logistic"),
        both(mean(graded, same), mean(graded, ~same)).alias("graded"), mean(off * off, F.lit(True)).alias("mse"),
    )


def triplet_losses(shells: DataFrame, margin: int = 4, keys: Sequence[str] = ("direction", "bits", "qid")) -> DataFrame:
    """(keys, triplets, hinge, ordered) over all (query, relevant row, other row): how many there are, the mean of
    max(0, margin + r of the relevant row - r of the other), and the share in which the relevant row is nearer, equals counted half.

    Sums over the other rows up to a distance come from range windows over a query's shells, so the cost is that of the histogram and
    not that of the triplets. A query without relevant or without other rows has no triplets: null hinge and ordered.
    """
    upto = lambda far: Window.partitionBy(*keys).orderBy("r").rangeBetween(Window.unboundedPreceding, far)
    total = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
    x = shells.select(*keys, "r", "m", (F.col("n") - F.col("m")).alias("o"))
    x = x.withColumns({"near": total("o", upto(margin - 1)), "sum": total(F.col("o") * F.col("r"), upto(margin - 1)), "closer": total("o", upto(-1))})
    hinge = F.col("m") * ((F.col("r") + margin) * F.col("near") - F.col("sum"))
    out = x.groupBy(*keys).agg((F.sum("m") * F.sum("o")).alias("triplets"), F.sum(hinge).alias("h"), F.sum(F.col("m") * (F.col("closer") + F.col("o") / 2)).alias("w"))
    t = F.nullif("triplets", F.lit(0))
    return out.select(*keys, "triplets", (F.col("h") / t).alias("hinge"), (1 - F.col("w") / t).alias("ordered"))
