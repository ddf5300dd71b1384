import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import local_order, subbag


def plain_groups(low, high, rel, graded):
    """By pairs: whoever is beaten by a remaining row waits."""
    left, out, number = set(range(len(low))), {}, 0
    while left:
        front = [i for i in left if not any(low[j] > high[i] for j in left)]
        front = [i for i in front if not any(rel[j].min() > rel[i].max() for j in front)]
        key = {i: (graded[i].mean(), graded[i].min(), graded[i].min() - graded[i].max(), rel[i].mean(), rel[i].min(), rel[i].min() - rel[i].max(), *sum(sorted(zip(rel[i].tolist(), graded[i].tolist())), ())) for i in front}
        best = max(key.values())
        for i in front:
            if key[i] == best:
                out[i] = number
        left -= {i for i in front if key[i] == best}
        number += 1
    return [out[i] for i in range(len(low))]


def test_groups_equal_pairwise_definition():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 14))
        mid = rng.integers(0, 5, n).astype(float)
        width = rng.integers(0, 3, n) / 2
        rel, graded = rng.integers(0, 3, (n, 2)) / 2, rng.integers(0, 3, (n, 2)) / 2
        got = local_order.groups(mid - width, mid + width, rel, graded)
        assert got.tolist() == plain_groups(mid - width, mid + width, rel, graded)
        order = rng.permutation(n)  # the order of rows has no part in it
        assert local_order.groups((mid - width)[order], (mid + width)[order], rel[order], graded[order]).tolist() == got[order].tolist()


def test_prefix_closes_ties_and_overlaps_and_refuses_more():
    score = np.array([5, 4, 4, 3, 2, 1], float)
    assert local_order.closed_prefix(score, score, score, 2, 6) == 3
    assert local_order.closed_prefix(score, score - [0, 1, 0, 0, 0, 0], score, 2, 6) == 4
    with pytest.raises(ValueError):
        local_order.closed_prefix(score, score - 2, score + 2, 1, 3)


def test_subbags_lose_no_row_and_follow_hashes(spark):
    import hashlib

    def hashed(h, i):
        return hashlib.sha256(f"subbag-v1\x0017\x00{h}\x00{i}".encode()).hexdigest()[:16]

    for keep in (0.0, 0.3, 0.8, 1.0):
        for r in spark.range(0, 500, 1, 3).select("id", subbag.subbag(F.col("id"), 3, keep).alias("heads")).collect():
            own = [hashed(h, r.id) for h in range(3)]
            want = sum(1 << h for h in range(3) if own[h] < subbag.threshold(keep))
            assert r.heads == (want or 1 << own.index(min(own)))


def test_query_meets_intervals_and_equals_pairwise_definition(spark):
    """local_partial_order against the definition by pairs, from the same rows."""
    import pandas as pd

    from bitloom.plans import local

    seen = []
    decode = local_order.decode
    local.local_order.decode = lambda rows, window: seen.append(rows.cache()) or decode(rows, window)
    try:
        got = {(r.qid, r.did): r.tie_group for r in local.local_partial_order(spark, "/root/testdata/sf0.001").collect()}
    finally:
        local.local_order.decode = decode
    rows = seen[0].toPandas()
    assert (rows.high > rows.low).any()
    some = sorted({q for q, _ in got})[:12]
    for q in some:
        g = rows[rows.qid == q].sort_values(["score", "did"], ascending=[False, True], ignore_index=True)
        n = sum(1 for a, _ in got if a == q)
        assert n >= 64 and (n == len(g) or g.score[n] < g.score[63])
        g = g.iloc[:n]
        want = plain_groups(*(g[c].to_numpy(float) for c in ("low", "high")), np.stack(g.relevance.to_list()), np.stack(g.graded.to_list()))
        assert [got[q, d] for d in g.did] == want
    assert isinstance(rows, pd.DataFrame) and some


def test_prefixes_longer_than_the_bound_are_taken_again(spark):
    """With a bound of 2 rows, then 16, and so on up to all, the rows are those of a bound that all meet."""
    from pyspark.sql import functions as F

    from bitloom.operators import local_order

    rows = lambda at, n: spark.createDataFrame([(i, i * 37 % 11, [float((i * 7 + j * 5) % 9 - 4) for j in range(32)]) for i in range(at, at + n)], "id long, code long, v array<float>")
    q, d = rows(0, 6), rows(100, 40)

    def intervals(found):
        found = found.select("qid", "did", (-F.col("r").cast("double")).alias("score"), F.array("r1", "r2").alias("relevance"), F.array("g1", "g2").alias("graded"))
        spread = (F.array_max("relevance") - F.array_min("relevance")) * 0.8
        return found.select("*", (F.col("score") - spread).alias("low"), (F.col("score") + spread).alias("high"))

    whole = sorted(local_order.decode(intervals(local_order.candidates(q, d)), 3).collect())
    assert sorted(local_order.decode_all(q, d, intervals, 3, 2).collect()) == whole and len(whole) > 6 * 3


def _sides(spark, codes, vectors, n):
    rows = lambda at, m, of, v: spark.createDataFrame([(i, of(i - at), v(i - at)) for i in range(at, at + m)], "id long, code long, v array<float>")
    return rows(0, n, lambda i: 0, lambda i: vectors(-1 - i)), rows(100, len(codes), lambda i: codes[i], vectors)


def _intervals(found):
    found = found.select("qid", "did", (-F.col("r").cast("double")).alias("score"), F.array("r1", "r2").alias("relevance"), F.array("g1", "g2").alias("graded"))
    spread = (F.array_max("relevance") - F.array_min("relevance")) * 0.8
    return found.select("*", (F.col("score") - spread).alias("low"), (F.col("score") + spread).alias("high"))


def test_rows_beyond_the_bound_reach_into_a_prefix(spark):
    """Of the second shell only the last row's interval meets the first shell's; a bound of 8 rows doesn't see it."""
    whole, turned = [1.0] * 32, [1.0] * 16 + [-1.0] * 16
    q, d = _sides(spark, [0] * 3 + [1] * 37, lambda i: turned if i in (0, 39) else whole, 2)
    want = sorted(local_order.decode(_intervals(local_order.candidates(q, d)), 3).collect())
    assert len(want) == 2 * 40
    assert sorted(local_order.decode_all(q, d, _intervals, 3, 8).collect()) == want
    assert sorted(local_order.decode_all(q, d, _intervals, 3, 8, 0.8).collect()) == want
    assert sorted(local_order.decode_whole(q, d, 0.8, 3).collect()) == want
    with pytest.raises(Exception, match="may reach"):
        local_order.decode(_intervals(local_order.candidates(q, d, 8)), 3, 8, reach=0.8).collect()


def test_whole_galleries_give_the_rows_of_all_candidates(spark, monkeypatch):
    rng = np.random.default_rng(2)
    codes = [int(x) for x in rng.integers(0, 1 << 16, 90) & rng.integers(0, 1 << 16, 90)]
    q, d = _sides(spark, codes, lambda i: None if i == 7 else [float(x) for x in np.random.default_rng(i + 50).integers(-3, 4, 32)], 9)
    want = sorted(local_order.decode(_intervals(local_order.candidates(q, d)), 5).collect())
    assert sorted(local_order.decode_whole(q, d, 0.8, 5).collect()) == want and len(want) > 9 * 5
    assert sorted(local_order.decode_all(q, d, _intervals, 5, 20, 0.8).collect()) == want
    monkeypatch.setattr(local_order, "WHOLE_ROWS", 10)  # rounds of growing candidates
    assert sorted(local_order.decode_all(q, d, _intervals, 5, 20, 0.8).collect()) == want


def test_groups_of_long_prefixes_in_few_steps():
    """20,000 rows of 17 shells: a look at all remaining rows for each group took over two seconds."""
    rng = np.random.default_rng(1)
    r = np.minimum(16, rng.binomial(16, 0.5, 20_000)).astype(float)
    draw = lambda sd: np.round(np.clip(rng.normal(0.5, sd, len(r)), 0, 1), 2)
    graded = np.stack([draw(0.18), draw(0.18)], 1)
    rel = np.round(np.stack([graded.mean(axis=1), draw(0.125)], 1), 2)
    half = np.abs(rel[:, 0] - rel[:, 1]) * 0.8
    low, high = -r - half, -r + half
    got = local_order.groups(low, high, rel, graded)
    left = np.ones(len(r), bool)
    for number in range(40):  # the first steps one at a time
        front = left & (high >= low[left].max())
        front &= rel.max(axis=1) >= rel[front].min(axis=1).max()
        best = local_order.numbered(rel[front], graded[front])
        taken = np.flatnonzero(front)[best == best.max()]
        assert (got[taken] == number).all() and (got == number).sum() == len(taken)
        left[taken] = False
