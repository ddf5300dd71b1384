"""Exact quantiles of groups of any size, without a group's values in one buffer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

#: Entries of a sketch, groups up to which brackets (two numbers for each share) are broadcast, and steps in which a bracket is narrowed.
ACCURACY, GROUPS, STEPS = 10_000, 10_000, 1_000


def _meet(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """`rows` with the columns of their group's row in `few`; null keys meet. No `by`: the one row there is."""
    if not by:
        return rows.crossJoin(F.broadcast(few))
    keyed = few.select(*(F.col(c).alias(f"__{c}") for c in by), *(c for c in few.columns if c not in by))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
    return rows.join(F.broadcast(keyed) if few.count() <= GROUPS else keyed, on).drop(*(f"__{c}" for c in by))


def _counted(rows: DataFrame, brackets: DataFrame, by: list[str], shares: list[float]) -> tuple[DataFrame, bool, int]:
    """`brackets` (by..., __n, __e) with __below and __inside, how many rows are below and inside each one; whether a place is outside its
    bracket; and the rows of the fullest bracket that has more than one value. One pass over the rows."""
    ks = range(len(shares))
    x, e = F.col("__x"), F.col("__e")
    held = _meet(rows, brackets, by)
    below = F.array(*(F.count_if(x < e[2 * i]) for i in ks)).alias("__below")
    inside = F.array(*(F.count_if(x.between(e[2 * i], e[2 * i + 1])) for i in ks)).alias("__inside")
    counts = settled(held.groupBy(*by).agg(F.first("__n").alias("__n"), F.first("__e").alias("__e"), below, inside))
    last = F.col("__n") - 1
    missed = [(F.floor(p * last) < F.col("__below")[i]) | (F.ceil(p * last) >= F.col("__below")[i] + F.col("__inside")[i]) for i, p in enumerate(shares)]
    full = F.greatest(F.lit(0), *(F.when(e[2 * i] < e[2 * i + 1], F.col("__inside")[i]).otherwise(0) for i in ks))
    seen = counts.agg(F.count_if(reduce(lambda a, b: a | b, missed)).alias("missed"), F.max(full).alias("full")).first()
    return counts, seen["missed"] > 0, seen["full"] or 0


def _narrowed(rows: DataFrame, counts: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """Brackets some `STEPS` times narrower than those of `counts`, from sketches of what is inside each of them."""
    x, e = F.col("__x"), F.col("__e")
    grid = F.array(*(F.lit(k / STEPS) for k in range(STEPS + 1)))
    sketches = (F.percentile_approx(F.when(x.between(e[2 * i], e[2 * i + 1]), x), grid, ACCURACY).alias(f"__s{i}") for i in range(len(shares)))
    own = _meet(rows, counts, by).groupBy(*by).agg(*(F.first(c).alias(c) for c in ("__n", "__e", "__below", "__inside")), *sketches)
    ends = []
    for i, p in enumerate(shares):
        step = F.floor((p * (F.col("__n") - 1) - F.col("__below")[i]) / F.col("__inside")[i] * STEPS).cast("int")
        ends += [F.when(step < 2, e[2 * i]).otherwise(F.get(f"__s{i}", step - 1)), F.when(step > STEPS - 3, e[2 * i + 1]).otherwise(F.get(f"__s{i}", step + 2))]
    return settled(own.select(*by, "__n", F.array(*ends).alias("__e")))


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], width: float = 4 / ACCURACY, most: int = 1_000_000) -> DataFrame:
    """(by..., one double for each name of `shares`): each group's quantiles, interpolated between neighbours; nulls don't count.

    A sketch of bounded size brackets each wanted place between two values. Rows below a bracket and inside it are counted; one that
    misses its place is made wider until it holds it, and one that holds over `most` rows is narrowed by a sketch of these rows, until
    it holds fewer or no fewer than before (equal values). Only rows inside are brought together and ordered, equal ones as one row
    with a count, so that neither a buffer nor an ordered part grows with a group. Results don't depend on the sketches. No rows: no
    groups, or without `by` one row of nulls.
    """
    names, ps = list(shares), list(shares.values())
    ks = range(len(names))
    rows = df.select(*by, F.col(value).cast("double").alias("__x")).where("__x is not null")
    ends = [min(1.0, max(0.0, p + s * width)) for p in ps for s in (-1, 1)]
    bracket = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.percentile_approx("__x", F.array(*map(F.lit, ends)), ACCURACY).alias("__e"))
    counts, missed, full = _counted(rows, settled(bracket), by, ps)
    if missed and width < 1:
        return quantiles(df, by, value, shares, min(1.0, width * 50), most)
    while full > most:
        closer, missed, now = _counted(rows, _narrowed(rows, counts, by, ps), by, ps)
        if missed or now >= full:
            break
        counts, full = closer, now
    held = _meet(rows, counts, by)
    e, x = F.col("__e"), F.col("__x")
    which = F.array(*(F.when(x.between(e[2 * i], e[2 * i + 1]), F.lit(i)) for i in ks))
    inside = held.select(*by, "__x", F.explode(F.array_compact(which)).alias("__i")).groupBy(*by, "__i", "__x").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*by, "__i").orderBy("__x"))
    placed = _meet(inside.withColumn("__upto", upto), counts, by).withColumn("__upto", F.col("__upto") + F.col("__below")[F.col("__i")])
    place = F.array(*map(F.lit, ps))[F.col("__i")] * (F.col("__n") - 1)
    at = lambda p: F.max(F.when((p >= F.col("__upto") - F.col("__c")) & (p < F.col("__upto")), x))
    found = placed.groupBy(*by, "__i").agg(at(F.floor(place)).alias("__a"), at(F.ceil(place)).alias("__z"), F.max(place).alias("__p"))
    q = F.when(F.col("__a") == F.col("__z"), F.col("__a")).otherwise((F.ceil("__p") - F.col("__p")) * F.col("__a") + (F.col("__p") - F.floor("__p")) * F.col("__z"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("__i") == i, q)).alias(c) for i, c in enumerate(names)))
