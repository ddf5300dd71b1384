"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled as settle

#: ASCII white space, which separates words; every other code point belongs to a word.
SPACES = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of `sf_dir`, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column `name`, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str) -> str:
    """A working name that no user's column has."""
    return f"__{name}_{uuid.uuid4().hex}"


def held_out(doc_id: Column, mod: int = 4, rest: int = 2) -> Column:
    """True where crc32 of the id's text leaves `rest`; a null id counts as the empty text (crc 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def with_results(df: DataFrame, result: Column, names: list[str]) -> DataFrame:
    """`df` with the fields `names` of the struct `result`; an input column of such a name (in any case) is replaced."""
    whole = fresh("r")
    taken = {n.lower() for n in names}
    kept = [quoted(c) for c in df.columns if c.lower() not in taken]
    return df.withColumn(whole, result).select(*kept, *(F.col(whole)[n].alias(n) for n in names))


def blocks(texts: pd.Series, chars: int = 4_000_000) -> Iterator[pd.Series]:
    """Consecutive pieces of `texts` of about `chars` characters, one text at least: what bounds the arrays made at once."""
    ends = texts.str.len().fillna(0).cumsum().to_numpy()
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(ends.searchsorted(base + chars)))
        yield texts.iloc[start:stop]
        start = stop


#: Keys with more rows than this, of which there can only be so many in a table, are joined by a broadcast.
CROWD = 20_000


def join_unevenly(rows: DataFrame, one: DataFrame, key: str, times: str, crowd: int = CROWD) -> DataFrame:
    """`rows` joined with `one`, which has a single row for each `key` and in `times` how many rows of `rows` have it; not null.

    Keys with more than `crowd` rows go another way, where they don't meet: their rows of `one`, at most one for `crowd` rows, are
    broadcast. Where even these are many, rows of such keys stay with the others.
    """
    hot = settle(one.where(F.col(times) > crowd))
    n = hot.count()
    if not 0 < n <= 50_000:
        return rows.join(one, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.where(F.col(times) <= crowd), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key).select(cold.columns))
