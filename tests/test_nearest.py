import random

import pytest
from pyspark.sql import functions as F

from bitloom.operators import nearest

MASK = {b: (1 << b) - 1 for b in (16, 32, 64)}


def signed(code):
    return code - (1 << 64) if code >= 1 << 63 else code


def clustered(rng, n, bits, centres, spread):
    out = []
    for _ in range(n):
        code = rng.choice(centres)
        for _ in range(rng.randint(0, spread)):
            code ^= 1 << rng.randrange(bits)
        out.append(code)
    return out


def brute(queries, gallery, k):
    out = set()
    for g, q, qc in queries:
        far = sorted((qc ^ c).bit_count() for h, _, c in gallery if h == g)
        edge = far[min(k, len(far)) - 1] if far else -1
        out |= {(g, q, d, (qc ^ c).bit_count()) for h, d, c in gallery if h == g and (qc ^ c).bit_count() <= edge}
    return out


def frames(spark, queries, gallery):
    q = spark.createDataFrame([(g, k, signed(c)) for g, k, c in queries], "g string, qid int, qcode long")
    d = spark.createDataFrame([(g, k, signed(c)) for g, k, c in gallery], "g string, did int, code long")
    return q, d


@pytest.mark.parametrize("bits, k, spread, flips", [(16, 3, 4, 4), (32, 5, 6, 4), (64, 4, 8, 4), (64, 7, 30, 1), (64, 500, 8, 2), (32, 2, 40, 0)])
def test_nearest_equals_all_pairs(spark, bits, k, spread, flips):
    rng = random.Random(bits * k)
    centres = [rng.getrandbits(bits) for _ in range(9)]
    gallery = [(rng.choice("ab"), n, c) for n, c in enumerate(clustered(rng, 300, bits, centres, spread))]
    gallery += [("a", 1000 + n, centres[0]) for n in range(40)]  # a code that many share, and ties at the edge
    queries = [(rng.choice("ab"), n, c) for n, c in enumerate(clustered(rng, 25, bits, centres, spread))] + [("a", 90, centres[0]), ("a", 91, centres[0]), ("c", 92, centres[0])]
    q, d = frames(spark, queries, gallery)
    got = nearest.nearest(q, d, k, bits, ["g"], flips).select("g", "qid", "did", "r").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(queries, gallery, k)


def test_widths_together(spark):
    rng = random.Random(8)
    gallery = [(b, n, rng.getrandbits(b)) for n in range(60) for b in (16, 32, 64)]
    queries = [(b, n, rng.getrandbits(b)) for n in range(6) for b in (16, 32, 64)]
    q = spark.createDataFrame([(g, k, signed(c)) for g, k, c in queries], "bits int, qid int, qcode long")
    d = spark.createDataFrame([(g, k, signed(c)) for g, k, c in gallery], "bits int, did int, code long")
    got = {tuple(r) for r in nearest.nearest(q, d, 5, "bits", ["bits"], 2).select("bits", "qid", "did", "r").collect()}
    assert got == brute(queries, gallery, 5)


def test_few_pairs_are_touched(spark):
    """Near neighbours among many codes: the pairs that meet are a small share of all."""
    rng = random.Random(3)
    gallery = [("a", n, rng.getrandbits(64)) for n in range(20_000)]
    queries = [("a", n, gallery[n * 7][2] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) for n in range(200)]
    q, d = frames(spark, queries, gallery)
    cells = d.groupBy("g", "code").agg(F.count("*").alias("n"))
    touched = sum(nearest._probed(q.select("g", "qcode").distinct(), cells, ["g"], F.lit(64), s).count() for s in range(2))
    assert touched < 0.01 * len(queries) * len(gallery)
    got = {(r.qid, r.did) for r in nearest.nearest(q, d, 1, 64, ["g"]).collect()}
    assert got == {(n, n * 7) for n in range(200)}


def test_nulls_and_empty_tables(spark):
    q, d = frames(spark, [("a", 1, 5)], [("a", 1, 5), ("a", 2, 7)])
    q = q.unionByName(spark.createDataFrame([("a", 2, None)], q.schema))
    d = d.unionByName(spark.createDataFrame([("a", 3, None)], d.schema))
    assert [(r.qid, r.did) for r in nearest.nearest(q, d, 1, 64, ["g"]).collect()] == [(1, 1)]
    assert nearest.nearest(q.limit(0), d, 1, 64, ["g"]).count() == 0
    assert nearest.nearest(q, d.limit(0), 1, 64, ["g"]).count() == 0
    with pytest.raises(ValueError):
        nearest.nearest_codes(q, d, 1, 20)
