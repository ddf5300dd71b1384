"""Encoders as plug-ins: a name, what it takes and gives, and the work as a column function or over batches of vectors.

A column encoder stays in the JVM. A batch encoder gets a numpy matrix of vectors and gives one of codes, in Arrow batches; it may load a
model once a task, as it is made by a factory there. Either way the result is held against the contract, and the first vector that breaks
it ends the job by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import pack


@dataclass(frozen=True)
class Encoder:
    """width: numbers that a code has; domain: the numbers there may be, or None for any finite one. One of column and batches is given."""

    name: str
    takes: int
    width: int
    domain: tuple[int, ...] | None = (-1, 1)
    column: Callable[[Column], Column] | None = None
    batches: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None


ENCODERS: dict[str, Encoder] = {}


def register(encoder: Encoder) -> Encoder:
    if (encoder.column is None) == (encoder.batches is None):
        raise ValueError(f"{encoder.name}: give column or batches")
    if encoder.name in ENCODERS:
        raise ValueError(f"{encoder.name} is there already")
    ENCODERS[encoder.name] = encoder
    return encoder


def encoder(name: str) -> Encoder:
    if name not in ENCODERS:
        raise ValueError(f"no encoder {name}, but {sorted(ENCODERS)}")
    return ENCODERS[name]


def _batched(own: Encoder, vector: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = own.batches()
        for vectors in batches:
            there = vectors.notna().to_numpy()
            out = pd.Series([None] * len(vectors), dtype=object)
            if there.any():
                codes = encode(np.stack(vectors[there].to_list()))
                if codes.shape[0] != there.sum():
                    raise ValueError(f"{own.name} gave {codes.shape[0]} codes for {there.sum()} vectors")
                out[np.flatnonzero(there)] = list(codes.astype(np.float32))
            yield out

    return F.pandas_udf(run, "array<float>")(vector)


def encode(vector: Column, name: str) -> Column:
    """The code (array<float>) of each vector; null for null. A vector or a code that breaks the contract is an error."""
    own = encoder(name)
    wrong = F.raise_error(F.concat(F.lit(f"{name} takes {own.takes} finite numbers, not "), F.to_json(vector)))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.when(vector.isNull(), F.lit(None)).when((F.size(vector) != own.takes) | odd, wrong.cast("array<float>")).otherwise(vector.cast("array<float>"))
    code = own.column(fit).cast("array<float>") if own.column else _batched(own, fit)
    if own.domain is None:
        out = F.exists(code, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    else:
        out = F.exists(code, lambda x: x.isNull() | ~x.isin(*map(float, own.domain)))
    broken = F.raise_error(F.concat(F.lit(f"{name} gave a code that is not {own.width} numbers of {own.domain or 'finite size'}: "), F.to_json(code)))
    return F.when(code.isNull(), F.lit(None)).when((F.size(code) != own.width) | out, broken.cast("array<float>")).otherwise(code)


def encode_distinct(df: DataFrame, vector: str, name: str, into: str = "code") -> DataFrame:
    """`df` with the code of `vector`: equal vectors are encoded once and met again by a hash of theirs, and by the vector itself.

    What moves of a row is its vector and whatever else `df` has: select what is needed. Null vectors keep a null code and don't meet.
    """
    hashed = df.withColumn("__h", F.xxhash64(vector))
    once = hashed.where(F.col(vector).isNotNull()).select("__h", F.col(vector).alias("__v")).distinct().withColumn(into, encode(F.col("__v"), name))
    met = hashed.where(F.col(vector).isNotNull()).join(once, "__h")
    met = met.where(F.col(vector) == F.col("__v")).drop("__h", "__v")
    return met.unionByName(df.where(F.col(vector).isNull()).withColumn(into, F.lit(None).cast("array<float>")))


def _signs(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.when(x >= 0, F.lit(1.0)).otherwise(F.lit(-1.0)))


def _hadamard() -> Callable[[np.ndarray], np.ndarray]:
    at = np.arange(64)
    turned = 1.0 - 2.0 * (np.bitwise_count(at[:, None] & at[None, :]) % 2)

    def run(vectors: np.ndarray) -> np.ndarray:
        return np.where(np.round(vectors.astype(np.float64) @ turned, 6) >= 0, 1, -1)

    return run


#: The signs of a vector, and the signs after a turn by the Hadamard matrix of 64 rows, which mixes all numbers into each.
SIGNS = register(Encoder("signs", 64, 64, column=_signs))
HADAMARD = register(Encoder("hadamard", 64, 64, batches=_hadamard))


def packed(code: Column) -> Column:
    """A bipolar code of up to 64 numbers as a long."""
    return pack(code)
