"""Operator 9, mixing to target weights: iterative proportional fitting, then sampling by the calibrated probabilities.

DataFrame operations alone. Token counts are summed into cells of (source, language, topic), and raking runs on the cells. A cell's
probability is its rake factor or 1, whichever is less, and the bound is part of the fitting: a round compares the tokens expected
under it with every margin's targets. A value cannot give more tokens than it has, so targets are first filled up to that. Documents meet
their cell's probability in one join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, settle

DIMENSIONS = ("source", "lang", "topic")
#: A margin's target shares are its token shares to this power, made to sum to 1: 1 keeps them, 0 makes them equal.
TEMPERATURES = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: Expected tokens kept, as a share of all.
BUDGET = 0.4
TOLERANCE, PER_STEP, STEPS = 1e-5, 6, 12
#: Up to so many cells are broadcast, and their margins summed by windows; more are joined and grouped by shuffles.
FEW_CELLS = 50_000
SEED = 9


def n_tokens(text: Column) -> Column:
    """Words of a whole text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A register that stands for the topic where a table has none: legal, contact, symbols, long or short."""
    plain = F.length(F.translate(text, "#*$%&|<>!", ""))
    return (
        F.when(text.contains("icense") | text.contains("rights reserved"), "legal")
        .when(text.contains("@"), "contact")
        .when(plain * 20 < F.length(text) * 19, "symbols")
        .when(tokens >= 400, "long")
        .otherwise("short")
    )


def _key(column: Column) -> Column:
    """A value that tells null from every string."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def wanted(cells: DataFrame, budget: float, temperatures: dict[str, float], targets: dict[str, dict[str, float]] | None, small: bool) -> DataFrame:
    """(dimension, value, t, want) of each margin's values: the tokens that there are and those wanted, `budget` of all in each dimension.

    Shares come from `targets`, or from token shares and `temperatures`. A value of which more is wanted than there is gives all it has,
    and the others of its dimension rise in proportion. Values without a share are not wanted.
    """
    out = None
    for d in DIMENSIONS:
        margin = cells.groupBy(F.col(d).alias("value")).agg(F.sum("t").alias("t"))
        share = F.pow(F.col("t").cast("double"), F.lit(float(temperatures[d])))
        if targets and d in targets:
            share = F.lit(0.0)
            for value, weight in targets[d].items():
                share = F.when(F.col("value") == f"={value}", F.lit(float(weight))).otherwise(share)
        margin = margin.select(F.lit(d).alias("dimension"), "value", "t", F.when(F.col("t") > 0, share).otherwise(0.0).alias("share"))
        out = margin if out is None else out.union(margin)
    out = settle(out.coalesce(1) if small else out)
    level: dict[str, float] = {}
    for _ in range(100):  # ends when no more values are full; each turn fills one at least
        want = F.lit(0.0)
        for d, x in level.items():
            want = F.when(F.col("dimension") == d, F.col("share") * x).otherwise(want)
        full = (want >= F.col("t")) & (F.col("share") > 0) if level else F.lit(False)
        got = out.groupBy("dimension").agg(F.sum("t").alias("all"), F.sum(F.when(full, F.col("t")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("share"))).alias("rest")).collect()
        new = {r.dimension: max(0.0, budget * r["all"] - r.full) / r.rest if r.rest else level.get(r.dimension, 0.0) for r in got}
        if all(abs(new[d] - level.get(d, -1.0)) <= 1e-12 * new[d] for d in new):
            break
        level = new
    want = F.lit(0.0)
    for d, x in level.items():
        want = F.when(F.col("dimension") == d, F.col("share") * x).otherwise(want)
    return settle(out.select("dimension", "value", "t", F.least(F.col("t").cast("double"), want).alias("want")))


def rake(cells: DataFrame, budget: float = BUDGET, temperatures: dict[str, float] = TEMPERATURES, targets: dict[str, dict[str, float]] | None = None, few: int = FEW_CELLS) -> DataFrame:
    """`cells` (source, lang, topic, t) with `probability`, `weight` and `gap`.

    Expected tokens t * probability meet what `wanted` says of every margin. weight is the share of expected tokens that a token of the
    cell stands for. Rounds end when no margin is off by more than TOLERANCE, or where margins contradict each other, when PER_STEP rounds gain
    next to nothing, or after STEPS times as many; gap is the greatest relative error that remains in the cell's three margins. Up to `few` cells, a window sums a margin
    and PER_STEP rounds are one job; beyond that, each sum is a group of its own, joined back.
    """
    small = cells.count() <= few
    goals = wanted(cells, budget, temperatures, targets, small)
    for d in DIMENSIONS:
        own = goals.where(F.col("dimension") == d).select(F.col("value").alias(d), F.col("want").alias(f"want_{d}"))
        cells = cells.join(own, d)
    cells = cells.withColumn("factor", F.lit(float(budget)))
    now = settle(cells.coalesce(1) if small else cells)  # few enough for one task, whose windows then need no shuffle
    expected = F.col("t") * F.least(F.lit(1.0), "factor")
    at_bound = F.when(F.col("factor") >= 1, F.col("t")).otherwise(0).cast("double")

    def summed(now: DataFrame, d: str) -> DataFrame:
        if small:
            own = Window.partitionBy(d)
            return now.withColumns({"sum": F.sum(expected).over(own), "full": F.sum(at_bound).over(own)})
        now = settle(now)
        return now.join(now.groupBy(d).agg(F.sum(expected).alias("sum"), F.sum(at_bound).alias("full")), d)

    def error(d: str) -> Column:
        want = F.col(f"want_{d}")
        return F.when(want > 0, F.abs(F.col("sum") / want - 1)).otherwise(F.when(F.col("sum") > 0, 1.0).otherwise(0.0))

    before = None
    for _ in range(STEPS):
        for _ in range(PER_STEP):
            for d in DIMENSIONS:
                want, free = F.col(f"want_{d}"), F.col("sum") - F.col("full")
                # a rise has to come from the cells below their bound
                rise = F.when((want > F.col("sum")) & (free > 1e-9 * F.col("sum")), (want - F.col("full")) / free)
                move = F.coalesce(rise, F.when(F.col("sum") > 0, want / F.col("sum")).otherwise(1.0))
                now = summed(now, d).withColumn("factor", F.least(F.col("factor") * move, F.lit(1e6))).drop("sum", "full")
        now = now.withColumn("gap", F.lit(0.0))
        for d in DIMENSIONS:
            now = summed(now, d).withColumn("gap", F.greatest("gap", error(d))).drop("sum", "full")
        now = settle(now)
        left = now.agg(F.max("gap")).first()[0] or 0.0
        if left <= TOLERANCE or before is not None and left > 0.98 * before:
            break
        before = left
    total = now.agg(F.sum(expected)).first()[0] or 1.0
    probability = F.least(F.lit(1.0), "factor")
    return now.select(*DIMENSIONS, "t", probability.alias("probability"), (probability / F.lit(total)).alias("weight"), "gap")


def chance(doc_id: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 that follows from the id alone: all copies of a row share it. A null id counts as the empty text."""
    h = F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


@dataclass
class Keyed:
    """rows: the input's columns, its tokens and its cell's keys; t and keys: the names of these."""

    rows: DataFrame
    t: str
    keys: dict[str, str]


def keyed(df: DataFrame, source: str = "source", lang: str = "lang", topic: str | None = None, text: str = "text") -> Keyed:
    """Tokens and keys of each row; without a topic column, the text's register is the topic."""
    t, keys = fresh("t"), {d: fresh(d) for d in DIMENSIONS}
    df = df.withColumn(t, n_tokens(quoted(text).cast("string")))
    own = _key(quoted(topic)) if topic else F.concat(F.lit("="), topic_of(F.coalesce(quoted(text).cast("string"), F.lit("")), F.col(t)))
    return Keyed(df.withColumns({keys["source"]: _key(quoted(source)), keys["lang"]: _key(quoted(lang)), keys["topic"]: own}), t, keys)


def cells_of(own: Keyed) -> DataFrame:
    """(source, lang, topic, t) for each cell."""
    return settle(own.rows.groupBy(*(F.col(own.keys[d]).alias(d) for d in DIMENSIONS)).agg(F.sum(own.t).alias("t")))


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", topic: str | None = None, text: str = "text", budget: float = BUDGET, seed: int = SEED, own: Keyed | None = None, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """`df` with `topic`, `n_tokens`, `weight`, `probability`, `gap` and `sampled`.

    Probabilities come from all rows; a null category is a value of its own, and null and empty texts have no tokens but a cell. A
    document is sampled if its id's hash is below its cell's probability, so repeated rows share a fate and runs agree; ties can't be.
    gap is above TOLERANCE where targets contradict each other. Very long texts count whole. An empty table gives an empty one; input
    columns named as a result are replaced. `own`: what `keyed` gave, its rows settled, to save a pass over texts.
    """
    names = ["topic", "n_tokens", "weight", "probability", "gap", "sampled"]
    own = own or keyed(df, source, lang, topic, text)
    to = {c: fresh(c) for c in (*DIMENSIONS, "weight", "probability", "gap")}
    cells = rake(cells_of(own), budget, targets=targets)
    cells = settle(cells.select(*(F.col(c).alias(n) for c, n in to.items())))
    small = cells.count() <= FEW_CELLS
    on = [F.col(own.keys[d]) == F.col(to[d]) for d in DIMENSIONS]
    out = own.rows.join(F.broadcast(cells) if small else cells, on)
    kept = [quoted(c) for c in df.columns if c.lower() not in names]
    topic_key = F.col(own.keys["topic"])
    return out.select(
        *kept, F.when(topic_key != "null", F.substr(topic_key, F.lit(2))).alias("topic"), F.col(own.t).alias("n_tokens"), F.col(to["weight"]).alias("weight"),
        F.col(to["probability"]).alias("probability"), F.col(to["gap"]).alias("gap"), (chance(quoted(doc_id), seed) < F.col(to["probability"])).alias("sampled"),
    )
