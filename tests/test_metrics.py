"""Exact tie expectations against every order, moments against scans, and hand values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions import codes as C
from bitloom.functions import labels as L
from bitloom.functions.series import harmonic, with_series
from bitloom.operators import metrics, minhash, moments, provenance, rank
from bitloom.sources.items import least_hashes


def plain(ranked, k):
    """ap, p, r, ndcg and graded sum of one order of gains."""
    rel = [g > 0 for g in ranked]
    total = sum(rel)
    hits, ap, dcg, graded = 0, 0.0, 0.0, 0.0
    for i, g in enumerate(ranked):
        hits += rel[i]
        ap += hits / (i + 1) if rel[i] else 0
        if i < k:
            dcg += rel[i] / math.log2(i + 2)
            graded += g / math.log2(i + 2)
    top = sum(rel[:k])
    ideal = sum(1 / math.log2(i + 2) for i in range(min(total, k, len(rel))))
    return [ap / total if total else 0, top / min(k, len(rel)), top / total if total else 0, dcg / ideal if total else 0, graded]


def test_expectations_equal_every_tie_order(spark):
    rng = np.random.default_rng(20260823)
    rows, want = [], {}
    for q in range(24):
        n = int(rng.integers(1, 7))
        dist, gain = rng.integers(0, 4, n).tolist(), rng.choice([0, 0.25, 0.5, 1], n).tolist()
        rows += [("x", 16, q, r, g) for r, g in zip(dist, gain)]
        shells = [[g for d, g in zip(dist, gain) if d == r] for r in sorted(set(dist))]
        for k in (1, 3, 8):
            orders = [plain(sum(map(list, o), []), k) for o in itertools.product(*(itertools.permutations(s) for s in shells))]
            want[q, k] = np.mean(orders, axis=0)
    df = spark.createDataFrame(rows, "direction string, bits int, qid int, r int, gain double")
    shells = df.groupBy("direction", "bits", "qid", "r").agg(F.count("*").alias("n"), F.sum((F.col("gain") > 0).cast("long")).alias("m"), F.sum("gain").alias("g"))
    for r in metrics.query_metrics(shells, (1, 3, 8)).collect():
        for k in (1, 3, 8):
            assert np.allclose([r.ap, r[f"p_{k}"], r[f"r_{k}"], r[f"ndcg_{k}"], r[f"dcg_{k}"]], want[r.qid, k])
    ideal = {r.qid: r.ideal for r in metrics.ideal_gain(df.groupBy("direction", "bits", "qid", "gain").agg(F.count("*").alias("n")), 3).collect()}
    for q, v in ideal.items():
        gains = sorted((g for *_, i, _, g in rows if i == q), reverse=True)[:3]
        assert math.isclose(v, sum(g / math.log2(i + 2) for i, g in enumerate(gains)), abs_tol=1e-12)


def test_harmonic_numbers(spark):
    got = with_series(spark.range(0, 3000).select("id")).select("id", harmonic(F.col("id")).alias("h")).collect()
    for r in got:
        assert math.isclose(r.h, math.fsum(1 / j for j in range(1, r.id + 1)), rel_tol=1e-13, abs_tol=1e-13)


def test_random_order_is_the_mean_of_all(spark):
    want = np.mean([plain([1, 1, 0, 0, 0][:0] + list(o), 5)[0] for o in itertools.permutations([1, 1, 0, 0, 0])])
    got = with_series(spark.createDataFrame([(5, 2)], "n long, m long")).select(metrics.random_ap(F.col("n"), F.col("m"))).first()[0]
    assert math.isclose(got, want)


def test_precision_recall_by_hand(spark):
    # one query: tie block of 2 with 1 relevant, then 1 relevant; another has none and is left out
    rows = [("x", 16, 1, 0, 2, 1, 1.0), ("x", 16, 1, 1, 1, 1, 1.0), ("x", 16, 2, 0, 3, 0, 0.0)]
    df = spark.createDataFrame(rows, "direction string, bits int, qid int, r int, n long, m long, g double")
    got = {r.grid: r.precision for r in metrics.precision_recall(df, 4).collect()}
    assert got == {g: pytest.approx(2 / 3) for g in range(5)}


@pytest.mark.parametrize("bits", [16, 32, 64])
def test_moments_equal_a_scan(spark, bits):
    rng = np.random.default_rng(7)
    bank = [int(x) for x in rng.integers(-(2**62), 2**62, 257)]
    q = int(rng.integers(-(2**62), 2**62))
    df = spark.createDataFrame([(x,) for x in bank], "code long")
    m = moments.bank_moments(df, C.unpack(F.col("code"), bits))
    mean, var = moments.radius_population(C.unpack(F.lit(q), bits), F.col("n"), F.col("bit_sum"), F.col("gram"), bits)
    got = m.select(mean, var).first()
    mask = (1 << bits) - 1
    r = [((x ^ q) & mask).bit_count() for x in bank]
    assert np.allclose(got, [np.mean(r), np.var(r)], atol=1e-12)


def test_degenerate_bank_scores_by_distance(spark):
    got = spark.range(0, 5).select(moments.z_score(F.col("id"), F.lit(1.0), F.lit(0.0), F.lit(True), 4)).collect()
    assert [r[0] for r in got] == [0, -0.25, -0.5, -0.75, -1]


def test_codes_round_trip_and_distances_agree(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(rng.normal(size=32).tolist(),) for _ in range(40)] + [([0.0] * 32,)], "v array<double>")
    got = df.select("v", C.code(F.col("v"), 64).alias("c"), C.unpack(C.code(F.col("v"), 32), 32).alias("u")).collect()
    for r in got:
        assert r.u == [1 if x >= 0 else -1 for x in r.v]
        assert all((r.c >> i & 1) == (r.v[i] >= 0) for i in range(32)) and all((r.c >> 32 + i & 1) == (r.v[i] - r.v[(i + 1) % 32] >= 0) for i in range(32))
    a, b = C.unpack(F.lit(-7), 64), C.unpack(F.lit(123456789), 64)
    assert len(set(spark.range(1).select(C.hamming(F.lit(-7).cast("long"), F.lit(123456789).cast("long")), C.hamming_by_difference(a, b), C.hamming_by_product(a, b, 64)).first())) == 1


def test_active_sets_take_the_first_of_the_greatest(spark):
    df = spark.createDataFrame([([0.2, 0.7, 0.6],), ([0.3, 0.3, 0.1],)], "p array<double>")
    assert [r[0] for r in df.select(L.active(F.col("p"), 0.5)).collect()] == [[1, 2], [0]]
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(*(minhash.expected_mismatch(F.lit(j), 16) for j in (1.0, 0.0, 0.5))))).collect()] == [0, 8, 4]


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_ranks_by_blocks_equal_a_sort(spark, rows, monkeypatch):
    monkeypatch.setattr(rank, "MOST_BLOCKS", 16)
    rng = np.random.default_rng(11)
    ids = rng.permutation(10 ** np.arange(60) % 10_007 * 3 + np.arange(60) // 20)  # gaps, and some ids more than once
    gallery = spark.createDataFrame([(int(i), int(rng.integers(4)), int(rng.integers(3))) for i in ids], "did long, r int, dlabel int")
    q = spark.createDataFrame([("i2t", 16, q, q) for q in range(4)], "direction string, bits int, qid long, qlabel int")
    blocked = rank.in_blocks(gallery, rows=rows).dropDuplicates(["did"])
    found = q.crossJoin(blocked)
    got = rank.stable_rank(found, "r").collect()
    aps = {r.qid: r.ap for r in rank.stable_ap(found, F.col("qlabel") == F.col("dlabel"), "r").collect()}
    n_blocks = blocked.agg(F.countDistinct("block")).first()[0]
    assert (n_blocks == 1) == (rows == 10_000) and n_blocks <= 17
    for q in range(4):
        own = sorted((r.r, r.did, r.dlabel) for r in got if r.qid == q)
        assert [(r.rank, r.r, r.did) for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == [(k + 1, a, b) for k, (a, b, _) in enumerate(own)]
        assert {(r.r, r.tie_group) for r in got if r.qid == q} == {(a, k) for k, a in enumerate(sorted({a for a, _, _ in own}))}
        at = [k + 1 for k, x in enumerate(own) if x[2] == q]
        assert aps[q] == pytest.approx(sum((k + 1) / p for k, p in enumerate(at)) / len(at) if at else 0.0)


def test_blocks_of_queries_give_the_same_pairs(spark):
    q, d = spark.range(0, 23).select(F.col("id").alias("qid")), spark.range(0, 50).select(F.col("id").alias("did"))
    assert rank.against_all(q, d, block=5).distinct().count() == rank.against_all(q, d).count() == 23 * 50


def test_least_hashes_equal_a_sort(spark):
    import hashlib

    df = spark.range(0, 500)
    got = {r.id for r in least_hashes(df, "query", 61, "f").where("f").collect()}
    h = lambda i: hashlib.sha256("\0".join(("split-v1", "42", "embeddings", "query", str(i))).encode()).hexdigest()
    assert got == set(sorted(range(500), key=lambda i: (h(i), i))[:61])
    assert least_hashes(df, "query", 0, "f").where("f").count() == 0 and least_hashes(df, "query", 500, "f").where("f").count() == 500


def test_merkle_root_and_holes(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = [sha(str(i)) for i in range(11)]
    now = leaves
    while len(now) > 1:
        now = [sha(now[i] + now[min(i + 1, len(now) - 1)]) for i in range(0, len(now), 2)]
    df = spark.createDataFrame(list(enumerate(leaves)), "i long, h string")
    assert provenance.merkle_levels(df).first().root == now[0]
    gaps = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 9)], "k string, n long")
    assert [tuple(r) for r in provenance.holes(gaps, "k", "n").collect()] == [("a", 2, 4)]


def test_quantiles_equal_sorted_values(spark):
    from bitloom.operators.quantile import quantiles

    rng = np.random.default_rng(5)
    groups = {"ties": [1.0] * 900 + [2.0] * 100, "one": [7.5], "wide": (10.0 ** rng.uniform(-9, 9, 3001)).tolist(), None: rng.normal(0, 1, 2000).tolist(), "none": []}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("wide", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    # too narrow a bracket is made wider, and one of too many rows is narrowed again
    for width, most in ((1e-9, 1_000_000), (1.0, 20)):
        got = {r.k: list(r)[1:] for r in quantiles(df, ["k"], "x", shares, width, most).collect()}
        assert got.keys() == {"ties", "one", "wide", None}
        for k, found in got.items():
            assert np.allclose(found, np.quantile(groups[k], list(shares.values())), rtol=1e-12)
    assert quantiles(df.where("false"), ["k"], "x", shares).count() == 0
    whole = quantiles(df, [], "x", {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.quantile(sum(groups.values(), []), 0.5))
    assert quantiles(df.where("false"), [], "x", {"m": 0.5}).collect() == [(None,)]


def test_a_crowded_bracket_is_narrowed_before_it_is_ordered(spark):
    from bitloom.operators import quantile

    df = spark.range(200_000).select(F.lit(1).alias("k"), F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.hash("id") / 2.0**31).alias("__x"))
    n, ps = df.count(), [0.1, 0.5]
    whole = spark.createDataFrame([(1, n, [-9.0, 9.0] * 2)], "k int, __n long, __e array<double>")
    counts, missed, full = quantile._counted(df, whole, ["k"], ps)
    closer, missed_now, fewer = quantile._counted(df, quantile._narrowed(df, counts, ["k"], ps), ["k"], ps)
    assert not missed and not missed_now and full == n and fewer < n / 200
    values = [r["__x"] for r in df.collect()]
    got = quantile.quantiles(df, ["k"], "__x", {"a": 0.1, "b": 0.5, "c": 0.7}, 1.0, 100).first()
    assert np.allclose(list(got)[1:], np.quantile(values, [0.1, 0.5, 0.7]), rtol=1e-12)


def test_masks_give_the_arrays_jaccard(spark):
    sets = [[], [0], [1, 62], [0, 1, 2], [62], [63], [-1, 2], [1, 2]]
    df = spark.createDataFrame([(a, b) for a in sets for b in sets], "a array<int>, b array<int>")
    mask = L.mask_jaccard(L.label_mask(F.col("a")), L.label_mask(F.col("b")))
    for r in df.select("a", "b", mask.alias("m"), L.jaccard(F.col("a"), F.col("b")).alias("j")).collect():
        beyond = any(not 0 <= i <= 62 for i in [*r.a, *r.b])
        assert r.m is None if beyond else r.m == r.j
