"""A partial order over the first rows of each query: score intervals first, then relevance intervals, then graded evidence.

Relational operators cannot say "take the best, then look again", so each query's bounded prefix is one group of a grouped map. An
interval is beaten when some other one lies wholly above it, thus when its upper end is below the greatest lower end: two maxima replace
any table of pairs, and steps between which neither maximum changes are one look at the rows in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .meeting import distance, meet
from .similarity import BATCH_ROWS, first, half_up, vectors_of

WINDOW, MOST = 128, 2048
#: Gallery rows of a block of `candidates`; of a block, with queries, of `decode_whole`.
BLOCK_ROWS, WHOLE_ROWS, WHOLE_QUERIES = 65_536, 1 << 20, 4_096


def closed_prefix(score: np.ndarray, low: np.ndarray, high: np.ndarray, window: int, most: int) -> int:
    """How many rows, by falling score, the prefix of `window` rows has once ties and overlaps with its lowest end are in it.

    More than `most` is an error: the order below is not meant for whole galleries.
    """
    end = min(window, len(score))
    while True:
        new = end + int((score[end:] == score[end - 1]).sum())
        reach = np.flatnonzero(high >= low[:new].min())
        new = max(new, int(reach[-1]) + 1)
        if new > most:
            raise ValueError(f"a closed prefix of {new} rows exceeds {most}")
        if new == end:
            return end
        end = new


def numbered(relevance: np.ndarray, graded: np.ndarray) -> np.ndarray:
    """The place of each row's key, from 0: graded mean, least and spread, the same of relevance, then the sorted pairs of heads."""
    at = np.lexsort((graded, relevance), axis=1)
    pairs = [np.take_along_axis(x, at, 1) for x in (relevance, graded)]
    sides = [c for x in (graded, relevance) for c in (x.mean(axis=1), x.min(axis=1), x.min(axis=1) - x.max(axis=1))]
    key = np.stack([*sides, *(x[:, i] for i in range(relevance.shape[1]) for x in pairs)])
    order = np.lexsort(key[::-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.r_[0, (key[:, order[1:]] != key[:, order[:-1]]).any(axis=0).cumsum()][: len(order)]
    return out


def groups(low: np.ndarray, high: np.ndarray, relevance: np.ndarray, graded: np.ndarray) -> np.ndarray:
    """The rank group of each row, from 0; relevance and graded: rows x heads.

    Each step keeps the rows that no remaining score interval beats, of them those that no relevance interval (over heads) beats, and
    of them the greatest by graded mean, least and spread, the same of relevance, then the sorted pairs of heads; equals share a group.
    """
    number_of = numbered(relevance, graded)
    floor, top = (np.unique(np.r_[relevance.min(axis=1), relevance.max(axis=1)], return_inverse=True)[1].reshape(2, -1)).astype(np.int32)
    lows, low_of = np.unique(low, return_inverse=True)
    lowest = np.bincount(low_of)  # how many remaining rows have each lower end
    by_high = np.argsort(-high, kind="stable")
    reach = -high[by_high]
    out = np.full(len(low), -1)
    # the front, greatest first: its rows, with minus their number, floor, top and lower end; floor and top are -1 once a row is taken
    rows = number = np.zeros(0, np.int64)
    f = t = of = number
    entered, at, gone, group = 0, len(lows) - 1, 0, 0
    left = len(low)
    while left:
        while not lowest[at]:
            at -= 1
        upto = int(np.searchsorted(reach, -lows[at], "right"))
        if upto > entered or gone * 2 > len(rows):
            new = by_high[entered:upto]
            rows = np.r_[rows[f >= 0], new[np.argsort(-number_of[new], kind="stable")]]
            rows = rows[np.argsort(-number_of[rows], kind="stable")]  # two runs
            number, f, t, of = -number_of[rows], floor[rows], top[rows], low_of[rows]
            entered, gone = upto, 0
        most = f.max()
        last = len(f) - 1 - int(np.argmax(f[::-1] == most))
        some = np.flatnonzero(t[: int(np.searchsorted(number, number[last], "right"))] >= most)  # until no floor is the greatest
        held = some[of[some] == at]
        if len(held) == lowest[at]:  # or no lower end
            some = some[: int(np.searchsorted(some, np.searchsorted(number, number[held[-1]], "right")))]
        steps = np.r_[0, (np.diff(number[some]) > 0).cumsum()]
        out[rows[some]] = group + steps
        group += int(steps[-1]) + 1
        lowest -= np.bincount(of[some], minlength=len(lowest))
        f[some] = t[some] = -1
        left -= len(some)
        gone += len(some)
    return out


#: Parts of a vector whose cosines are heads: two of relevance, two of graded evidence.
HEADS = {"r1": (0, 16), "r2": (16, 32), "g1": (0, 8), "g2": (8, 16)}


def _length(v: np.ndarray, a: int, b: int) -> np.ndarray:
    total = np.zeros(v.shape[1:])
    for i in range(a, b):
        total = total + v[i] * v[i]
    return np.maximum(np.sqrt(total), 1e-8)


def _heads(v: np.ndarray, near: np.ndarray, lengths: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """(cosine + 1) / 2 of each part of a vector with those of others, by column of `near`, to 2 places; lengths: of the others' parts."""
    out = {}
    for h, (a, b) in HEADS.items():
        dot = np.zeros(near.shape[1])
        for i in range(a, b):
            dot += v[i] * near[i]
        out[h] = half_up((dot / (_length(v, a, b) * lengths[h]) + 1) / 2, 2)
    return out


def candidates(queries: DataFrame, gallery: DataFrame, most: int = MOST) -> DataFrame:
    """(qid, did, r, r1, r2, g1, g2): of each block of the gallery the `most` + 1 rows of least 16-bit distance r, ties to the lesser id, and
    their heads: (cosine + 1) / 2 of a part, to 2 places. Both: (id, code, v); rows without a code or a whole vector of 32 are left out."""
    far = distance(16)

    def each(g: pa.Table, q: pa.Table) -> Iterator[dict[str, Any]]:
        (gv, gone), (qv, none) = vectors_of(g, "v", 32), vectors_of(q, "v", 32)
        dids, codes = g["id"].to_numpy()[~gone], g["code"].to_numpy()[~gone].view(np.uint64)
        gv = np.ascontiguousarray(gv[~gone].T)
        lengths = {h: _length(gv, *part) for h, part in HEADS.items()}
        for id, own, v in zip(q["id"].to_numpy()[~none], q["code"].to_numpy()[~none].view(np.uint64), qv[~none]):
            r = far(codes ^ own).astype(np.int64)
            at = first(r, most + 1)
            yield {"qid": np.full(len(at), id), "did": dids[at], "r": r[at]} | _heads(v, gv[:, at], {h: x[at] for h, x in lengths.items()})

    some = [x.where("code is not null") for x in (queries, gallery)]
    return meet(*some, each, "qid long, did long, r int, r1 double, r2 double, g1 double, g2 double", 256, BLOCK_ROWS)


def decode_whole(queries: DataFrame, gallery: DataFrame, widen: float, window: int = WINDOW) -> DataFrame:
    """`decode` where a row's score is -r, its relevance (r1, r2), its graded evidence (g1, g2) and its interval as wide to each side as
    `widen` times the spread of its relevance; both sides as in `candidates`. The gallery is one block of every task, so a query's shells
    are taken one by one until its prefix is closed, and only the order leaves the task."""

    def each(g: pa.Table, q: pa.Table) -> Iterator[dict[str, Any]]:
        (gv, gone), (qv, none) = vectors_of(g, "v", 32, g["v"].type.value_type.to_pandas_dtype()), vectors_of(q, "v", 32)
        dids, codes = g["id"].to_numpy()[~gone], g["code"].to_numpy()[~gone].astype(np.uint16)
        gv = gv[~gone] if gone.any() else gv
        held: list[dict[str, np.ndarray]] = []
        rows = 0
        for id, own, v in zip(q["id"].to_numpy()[~none], q["code"].to_numpy()[~none].astype(np.uint16), qv[~none]):
            r = np.bitwise_count(codes ^ own)
            counts = np.bincount(r, minlength=17)
            if not len(r):
                continue
            end = min(int(np.searchsorted(counts.cumsum(), min(window, len(r)))), 16)  # the last shell of the prefix
            shells: list[tuple[np.ndarray, ...]] = []
            seen = -1
            while seen < 16:
                # a shell that is no part of the prefix may reach it, as far as the greatest spread, 1
                lowest = min((low.min() for _, low, *_ in shells[: end + 1] if len(low)), default=np.inf)
                if seen >= end and widen - (seen + 1) < lowest:
                    break
                seen += 1
                at = np.flatnonzero(r == seen)
                near = np.ascontiguousarray(gv[at].T, float)
                heads = _heads(v, near, {h: _length(near, *part) for h, part in HEADS.items()})
                relevance, graded = (np.stack([heads[f"{x}1"], heads[f"{x}2"]], 1) for x in "rg")
                spread = (relevance.max(axis=1) - relevance.min(axis=1)) * widen
                shells.append((at, -float(seen) - spread, -float(seen) + spread, relevance, graded))
                if seen >= end:
                    end = _closed(shells, end)
            at, *rest = (np.concatenate(x) for x in zip(*shells[: end + 1]))
            held.append({"qid": np.full(len(at), id), "did": dids[at], "tie_group": groups(*rest)})
            rows += len(at)
            if rows >= BATCH_ROWS:
                yield {n: np.concatenate([f[n] for f in held]) for n in held[0]}
                held, rows = [], 0
        if held:
            yield {n: np.concatenate([f[n] for f in held]) for n in held[0]}

    some = [x.where("code is not null") for x in (queries, gallery)]
    return meet(*some, each, "qid long, did long, tie_group long", WHOLE_QUERIES, WHOLE_ROWS)


def _closed(shells: list[tuple[np.ndarray, ...]], end: int) -> int:
    """The last shell of the prefix once all seen shells that reach those up to `end` are in it."""
    while True:
        lowest = min((low.min() for _, low, *_ in shells[: end + 1] if len(low)), default=np.inf)
        new = max([end, *(k for k in range(end + 1, len(shells)) if (shells[k][2] >= lowest).any())])
        if new == end:
            return end
        end = new


def decode(rows: DataFrame, window: int = WINDOW, most: int = MOST, strict: bool = True, reach: float | None = None) -> DataFrame:
    """(qid, did, tie_group) of the closed prefix of each query; rows: qid, did, score, low, high, relevance and graded (arrays).

    A query whose prefix is not closed within `most` rows is an error, or, unless `strict`, gives one row without a did. Rows beyond those
    may reach into a prefix as well: it counts as closed if no interval's upper end is more than `reach` above its score and so cannot, and
    never without `reach`.

    Only the `most` + 1 best rows of a query, which a group limit keeps before the shuffle's sort, reach its task.
    """
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "did"))
    rows = rows.withColumn("place", place).where(F.col("place") <= most + 1)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        score, low, high = (group[c].to_numpy(float) for c in ("score", "low", "high"))
        try:
            n = closed_prefix(score, low, high, window, most)
            if len(group) > most and (reach is None or score[-1] + reach >= low[:n].min()):
                raise ValueError(f"rows beyond {most} may reach into the prefix")
        except ValueError:
            if strict:
                raise
            return pd.DataFrame({"qid": group["qid"].iloc[:1], "did": pd.array([None], "Int64"), "tie_group": pd.array([None], "Int64")})
        group = group.iloc[:n]
        got = groups(low[:n], high[:n], np.stack(group["relevance"].to_list()), np.stack(group["graded"].to_list()))
        return pd.DataFrame({"qid": group["qid"], "did": group["did"], "tie_group": got})

    return rows.groupBy("qid").applyInPandas(one, "qid long, did long, tie_group long")


def decode_all(queries: DataFrame, gallery: DataFrame, intervals: Callable[[DataFrame], DataFrame], window: int = WINDOW, most: int = MOST, widen: float | None = None) -> DataFrame:
    """`decode` of what `intervals` makes of `candidates`, however long prefixes are: queries whose prefix is not closed within `most` rows are
    taken again, alone, with eight times as many, up to the whole gallery. Each round is checkpointed. `widen` says that `intervals` are
    those of `decode_whole`, which then takes galleries that are one block; without it a prefix is known to be closed once all rows are seen."""
    total, left, done = gallery.count(), queries, []
    if total <= most:
        return decode(intervals(candidates(queries, gallery, most)), window)
    if widen is not None and total <= WHOLE_ROWS:
        return decode_whole(queries, gallery, widen, window)
    while True:
        got = settled(decode(intervals(candidates(left, gallery, most)), window, most, most >= total, widen))
        done.append(got.where("did is not null"))
        again = got.where("did is null").select(F.col("qid").alias("id"))
        if most >= total or again.isEmpty():
            return reduce(DataFrame.unionByName, done)
        left, most = left.join(again, "id", "left_semi"), most * 8
