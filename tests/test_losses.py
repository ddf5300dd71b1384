"""Losses from histograms against plain sums over all pairs and triplets."""

import itertools
import math

import numpy as np
import pytest

from bitloom.operators import losses, rank


@pytest.fixture(scope="module")
def drawn(spark):
    rng = np.random.default_rng(3)
    names = "id int, is_q boolean, is_d boolean, labels array<int>, image long, text long"
    rows = [(i, i < 9, i >= 9, sorted(rng.choice(4, rng.integers(0, 3), replace=False).tolist()), int(rng.integers(2**20)), int(rng.integers(2**20))) for i in range(60)]
    rows += [(100 + i, *rows[20 + i][1:]) for i in range(10)]  # repeated codes and labels
    return rows, spark.createDataFrame(rows, names)


def plain(rows, direction, bits):
    """By query: (r, gain) of each gallery row."""
    a, b = (4, 5) if direction == "i2t" else (5, 4)
    mask = (1 << bits) - 1
    gain = lambda p, q: len(set(p) & set(q)) / len(set(p) | set(q)) if p or q else 0.0
    return {q[0]: [(((q[a] ^ d[b]) & mask).bit_count(), gain(q[3], d[3])) for d in rows if d[2]] for q in rows if q[1]}


def test_pair_losses(drawn):
    rows, df = drawn
    found = losses.pair_losses(rank.graded_counts(df, (16, 64))).collect()
    assert len(found) == 4
    for x in found:
        pairs = sum(plain(rows, x.direction, x.bits).values(), [])
        kinds = []
        for same in (True, False):
            own = [(1 - 2 * r / x.bits, g) for r, g in pairs if (g > 0) == same]
            kinds.append((np.mean([math.log1p(math.exp(-5 * s if same else 5 * s)) for s, _ in own]), np.mean([o * o / 0.2 if o < 0.1 else o - 0.05 for o in (abs((s + 1) / 2 - g) for s, g in own)])))
        assert x.n_pairs == len(pairs) and x.positive_share == pytest.approx(np.mean([g > 0 for _, g in pairs]))
        assert (x.logistic, x.graded) == pytest.approx(tuple(np.mean(kinds, axis=0)))
        assert x.mse == pytest.approx(np.mean([(1 - r / x.bits - g) ** 2 for r, g in pairs]))


@pytest.mark.parametrize("margin", [0, 1, 4])
def test_triplet_losses(drawn, margin):
    rows, df = drawn
    found = losses.triplet_losses(rank.nested_shells(df, (16, 64)), margin).collect()
    assert len(found) == 4 * 9 and any(x.triplets == 0 for x in found) and any(x.triplets for x in found)
    for x in found:
        own = plain(rows, x.direction, x.bits)[x.qid]
        both = [(p, o) for (p, g), (o, h) in itertools.product(own, own) if g > 0 and h == 0]
        assert x.triplets == len(both)
        want = (np.mean([max(0, margin + p - o) for p, o in both]), np.mean([1.0 if p < o else 0.5 if p == o else 0.0 for p, o in both])) if both else (None, None)
        assert (x.hinge, x.ordered) == pytest.approx(want)


def test_one_kind_alone_and_none(spark):
    counts = lambda rows: spark.createDataFrame(rows, "direction string, bits int, r int, gain double, n long")
    one = losses.pair_losses(counts([("i2t", 16, 0, 1.0, 3)])).first()
    assert (one.positive_share, one.graded, one.mse) == (1.0, 0.0, 0.0) and one.logistic == pytest.approx(math.log1p(math.exp(-5)))
    far = losses.pair_losses(counts([("i2t", 16, 16, 0.0, 3)]), scale=1000.0).first()
    assert (far.positive_share, far.logistic) == (0.0, pytest.approx(0.0))
    assert losses.pair_losses(counts([])).count() == 0
    assert losses.triplet_losses(spark.createDataFrame([], "direction string, bits int, qid long, r int, n long, m long, g double")).count() == 0
