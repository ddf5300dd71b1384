"""Contracts on several tables of one id, checked together.

Every table gives a row for each of its rows, with the row rules it breaks; one grouping by id then knows how often each table has the id,
which settles what a table lacks, repeats or shares with another, in both directions, without a join. Each table is read once, and what
a grouping moves is an id and a few flags; a repeated id is combined before rows meet.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import settled


@dataclass
class Part:
    """A table of a contract: its rows, the column that has the id, and rules by name, each a condition that a bad row meets."""

    rows: DataFrame
    id: str
    rules: dict[str, Column] = field(default_factory=dict)


def ledger(parts: dict[str, Part], across: dict[str, str]) -> DataFrame:
    """(id, n, broken): of each id how often each part has it (a map), and the names of the rules that it breaks, in order.

    across: conditions (SQL) over the parts' names, which stand for how often the part has the id: "codes > 1", "codes > 0 and labels = 0".
    A row without an id breaks the rule "part.id" and counts for the null id alone. A rule that is null for a row is not broken.
    """
    each = []
    for name, part in parts.items():
        rules = {f"{name}.id": F.col(part.id).isNull(), **{f"{name}.{r}": bad for r, bad in part.rules.items()}}
        broken = F.filter(F.array(*(F.when(bad, F.lit(r)) for r, bad in rules.items())), lambda r: r.isNotNull())
        each.append(part.rows.select(F.col(part.id).cast("long").alias("id"), F.lit(name).alias("part"), broken.alias("broken")))
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionAll(more)
    counts = [F.count_if(F.col("part") == name).alias(name) for name in parts]
    found = rows.groupBy("id").agg(*counts, F.flatten(F.collect_set("broken")).alias("own"))
    met = F.array(*(F.when(F.expr(f"id is not null and ({bad})"), F.lit(r)) for r, bad in across.items()))
    broken = F.array_sort(F.array_union("own", F.filter(met, lambda r: r.isNotNull())))
    return found.select("id", F.create_map(*(x for name in parts for x in (F.lit(name), F.col(name)))).alias("n"), broken.alias("broken"))


def violations(checked: DataFrame) -> DataFrame:
    """(rule, ids, example): how many ids break each broken rule, and the least of them."""
    return checked.select("id", F.explode("broken").alias("rule")).groupBy("rule").agg(F.count("*").alias("ids"), F.min("id").alias("example"))


def out_of_order(rows: DataFrame, place: str, value: str) -> DataFrame:
    """The places whose value is not above the value before; places are numbers that follow each other. No window over all rows."""
    both = F.array(F.struct(F.col(place).alias("at"), F.col(value).alias("own"), F.lit(None).cast("long").alias("before")), F.struct((F.col(place) + 1).alias("at"), F.lit(None).cast("long").alias("own"), F.col(value).alias("before")))
    met = rows.select(F.explode(both).alias("x")).groupBy("x.at").agg(F.max("x.own").alias("own"), F.max("x.before").alias("before"))
    return met.where("own <= before").select(F.col("at").alias(place), F.col("own").alias(value))


@dataclass(frozen=True)
class Seal:
    """What a set of rows adds up to: their number, and the sums of two hashes of each row, which no order of rows changes."""

    n: int
    first: int
    second: int


def _sums(columns: list[str]) -> list[Column]:
    whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in columns))
    hashes = F.xxhash64(whole), F.xxhash64(F.lit("second"), whole)
    return [F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias(n) for n, h in zip(("first", "second"), hashes))]


def seal(df: DataFrame) -> Seal:
    r = df.agg(*_sums(sorted(df.columns))).first()
    return Seal(r.n, int(r.first), int(r.second))


def materialize(df: DataFrame, path: str) -> Seal:
    """Writes `df` as Parquet and seals it while it is written: the rows are read once, and Spark's commit makes them visible as a whole."""
    watch = Observation()
    df.observe(watch, *_sums(sorted(df.columns))).write.mode("overwrite").parquet(path)
    got = watch.get
    return Seal(got["n"], int(got["first"]), int(got["second"]))


def verify(df: DataFrame, sealed: Seal) -> list[tuple[str, str, int]]:
    """What became of sealed rows: nothing if `df` has them all; else (kind, detail, rows) of what differs.

    One row more or less leaves its own hashes as the difference of both sums: a row that is twice there is found by them, and named. A
    difference at equal numbers is a changed row. Several faults together are "mixed".
    """
    columns = sorted(df.columns)
    now = seal(df)
    if now == sealed:
        return []
    gap = now.n - sealed.n
    if gap == 0:
        return [("changed", "rows differ at an equal number", 0)]
    if gap == 1:
        whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in columns))
        same = (F.xxhash64(whole) == now.first - sealed.first) & (F.xxhash64(F.lit("second"), whole) == now.second - sealed.second)
        if -(1 << 63) <= now.first - sealed.first < 1 << 63 and (found := df.where(same).limit(2).count()):
            return [("doubled" if found == 2 else "added", "one row", 1)]
        return [("mixed", "a row more, and others differ", 1)]
    if gap == -1 and all(-(1 << 63) <= a - b < 1 << 63 for a, b in ((sealed.first, now.first), (sealed.second, now.second))):
        return [("dropped", "one row", 1)]
    return [("added" if gap > 0 else "dropped", "rows, or others differ too", abs(gap))]


def receipts_match(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, state) of receipts and artifacts (key, n, digest) that don't belong together: lost, unknown, differs, or repeated on a side."""
    tell = lambda df, side: df.select(F.col(key).alias("key"), F.lit(side).alias("side"), "n", "digest")
    own = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    met = tell(expected, "e").unionAll(tell(found, "f")).groupBy("key").agg(
        F.count_if(F.col("side") == "e").alias("e"), F.count_if(F.col("side") == "f").alias("f"), *(own(c, s).alias(f"{c}_{s}") for c in ("n", "digest") for s in "ef")
    )
    differs = ~(F.col("n_e").eqNullSafe(F.col("n_f")) & F.col("digest_e").eqNullSafe(F.col("digest_f")))
    state = F.when((F.col("e") > 1) | (F.col("f") > 1), "repeated").when(F.col("f") == 0, "lost").when(F.col("e") == 0, "unknown").when(differs, "differs")
    return met.select(F.col("key").alias(key), state.alias("state")).where("state is not null")


def split_off(rows: DataFrame, id: str, checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): the rows whose id breaks nothing, and the others with `broken`; rows without an id are bad."""
    bad = settled(checked.where("size(broken) > 0").select(F.col("id").alias("__id"), "broken"))
    held = rows.join(bad, F.col(id).cast("long").eqNullSafe(F.col("__id")), "left").drop("__id")
    return held.where("broken is null").drop("broken"), held.where("broken is not null")
