"""Operator 6, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A word counts by itself, by its first STEM letters, which the forms of a word share in inflected languages, and with words near it.

McMahan and others, "Ad click prediction: a view from the trenches" (2013), gives the update: a learning rate for each coordinate
and an L1 term that leaves most weights at exactly 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, quoted, settle, with_results

#: Bits of a feature's number; letters of a stem; distances of the two words of a pair: next to each other, or with one or two between.
BITS = 18
STEM = 4
GAPS = (1, 2, 3)
#: The classifier is fitted on at most so many labelled rows, of those whose hashed ids are least.
SAMPLE = 12_000
ROUNDS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.01
_APART = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def features(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all stems, n-grams and skip-grams of whole texts, repeats included. Letters of a stem are bytes of UTF-8."""
    words = [(t or "").lower().encode().translate(_APART).split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter((crc32(w) for own in words for w in own), np.uint64, int(sizes.sum()))
    row = np.repeat(np.arange(len(words)), sizes)
    shift = np.uint64(64 - BITS)
    stem = np.fromiter((crc32(w[:STEM]) for own in words for w in own), np.uint64, len(h))
    rows, found = [row, row], [((h + np.uint64(1)) * _MULTIPLY[0]) >> shift, ((stem + np.uint64(1)) * _MULTIPLY[1]) >> shift]
    for k in GAPS:
        same = row[k:] == row[:-k]
        rows.append(row[k:][same])
        found.append(((((h[:-k] + np.uint64(k)) * _MULTIPLY[k]) ^ h[k:])[same] * _MULTIPLY[0]) >> shift)
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


@dataclass
class Weights:
    """The nonzero weights, which fit a broadcast: at most 2**BITS. `trained` is false if there was no labelled row."""

    at: np.ndarray
    value: np.ndarray
    bias: float
    trained: bool

    def scores(self, texts: pd.Series) -> np.ndarray:
        """Of each text: the logistic of the bias and the weights of its distinct features; 0 without training."""
        if not self.trained:
            return np.zeros(len(texts))
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.at] = self.value
        parts = []
        for some in blocks(texts):
            row, f = features(some)
            used = np.flatnonzero(dense[f])
            key = np.unique((row[used] << BITS) | f[used])
            total = np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)].astype(np.float64), len(some)) + self.bias
            parts.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return np.concatenate(parts) if parts else np.zeros(0)


def _weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def _coded(texts: pd.Series) -> pd.Series:
    """Of each text its distinct features in order."""
    out = []
    for some in blocks(texts):
        row, f = features(some)
        key = np.unique((row << BITS) | f)
        out += np.split((key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(1, len(some))))
    return pd.Series(out, dtype=object)


def _train(rows: list[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray) -> None:
    """FTRL-proximal over rows of distinct features, one after the other; the last coordinate is the bias, free of L1."""
    end = 1 << BITS
    for key, y in zip(rows, labels):
        own = np.append(key, end)
        zi, ni = z[own], n[own]
        w = _weight(zi, ni)
        w[-1] = -zi[-1] / ((BETA + np.sqrt(ni[-1])) / ALPHA)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        more = ni + g * g
        z[own] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
        n[own] = more


def fit(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Weights:
    """Weights learnt from the labelled rows of `docs` where `train` (over the ids of `labels`) is true.

    At most `sample` labelled ids, the least by hash, and of their distinct rows at most `sample`, again the least by hash, so that a
    run over more data fits the same way and no id can fill the task. Their features are found once, where the rows are; then they pass one
    after the other, in that order, ROUNDS times, each pass a task of its own that starts from the state before. Ids or labels that are null are left out; an id with several
    labels has the greatest, one with several texts each of them, a repeated row counts once. Null texts count as empty. No labelled
    row, or an empty table: weights that score 0.
    """
    chosen = labels.where(train & labels[doc_id].isNotNull() & labels[label].isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(quoted(doc_id).alias("id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.dropDuplicates(["id", "text"]).withColumn("at", F.xxhash64("id", "text")).orderBy("at", "id").limit(sample)
    rows = settle(rows)
    rows = rows.repartition(32, "at").select("at", "id", "y", F.pandas_udf(_coded, "array<int>")("text").alias("own"))
    rows = settle(rows.repartition(1).sortWithinPartitions("at", "id").select("y", "own"))  # bounded, and in order for every pass
    end = 1 << BITS
    z, n = np.zeros(end + 1), np.zeros(end + 1)
    for _ in range(ROUNDS):
        before = docs.sparkSession.sparkContext.broadcast((z, n))

        def follow(batches: Iterator[pd.DataFrame], before=before) -> Iterator[pd.DataFrame]:
            z, n = (x.copy() for x in before.value)
            for rows in batches:
                _train(list(rows["own"]), rows["y"].to_numpy(np.float64), z, n)
            used = np.flatnonzero(n)
            yield pd.DataFrame({"at": used, "z": z[used], "n": n[used]})

        state = rows.mapInPandas(follow, "at long, z double, n double").toPandas()
        before.unpersist()
        z[state["at"]], n[state["at"]] = state["z"], state["n"]
    trained = bool(n[end])
    w = _weight(z, n)[:end]
    at = np.flatnonzero(w)
    return Weights(at, w[at].astype(np.float32), float(-z[end] / ((BETA + np.sqrt(n[end])) / ALPHA)), trained)


def score(df: DataFrame, weights: Weights, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """`df` with `score` (0 to 1) and `predicted` (1 if the score is `threshold` or more) for each whole text; null counts as empty.

    A map over rows with the weights broadcast. Very long texts are read whole. Input columns named as a result are replaced; repeated
    rows get equal scores; an empty table gives an empty one.
    """
    common = df.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("score double, predicted int")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            s = common.value.scores(texts)
            yield pd.DataFrame({"score": s, "predicted": (s >= threshold).astype(np.int32)})

    return with_results(df, scored(quoted(text).cast("string")), ["score", "predicted"])
