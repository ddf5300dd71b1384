import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from bitloom.operators import exact, metrics, rank
from bitloom.sources.items import items, wide_codes, with_split


def same(a, b):
    return a == b or (a is None and b is None) or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def test_totals_equal_fsum_in_any_order(spark):
    rng = random.Random(4)
    odd = [5e-324, -5e-324, 2.0**-1022, 1.7e300, -1.7e300, 1e16, 1.0, -1e16, 0.1, -0.0, 1 / 3, 2.0**52 + 0.5, -(2.0**970)]
    rows = [(g, rng.choice(odd) if rng.random() < 0.3 else rng.uniform(-1, 1) * 2.0 ** rng.randint(-200, 200)) for g in ("a", "b") for _ in range(700)]
    rows += [("tiny", 5e-324)] * 3 + [("cancel", x) for x in (1e308, 1e-308, -1e308)] + [("null", None), ("none", None), ("none", 2.0)]
    rows += [("nan", math.nan), ("nan", 1.0), ("inf", math.inf), ("inf", -1.0), ("both", math.inf), ("both", -math.inf), (None, 0.25)]
    want = {}
    for g in {r[0] for r in rows}:
        own = [x for k, x in rows if k == g and x is not None]
        want[g] = (len(own), None if not own else math.nan if g == "both" else math.fsum(own))
    seen = []
    for n in (1, 7, 64):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "g string, x double").repartition(n)
        got = {r.g: r for r in exact.exact_sums(df, ["g"], ["x"]).collect()}
        assert got.keys() == want.keys()
        for g, (count, total) in want.items():
            assert got[g].n == count and same(got[g].total, total), g
        for g in ("a", "b", "cancel", "tiny"):
            whole = sum(Fraction(x) for k, x in rows if k == g)
            assert got[g].mean == float(whole / got[g].n) and got[g].error == float(abs(whole - Fraction(got[g].total)))
        seen.append(sorted((str(g), r.n, str(r.total), str(r.mean), str(r.error)) for g, r in got.items()))
    assert seen[0] == seen[1] == seen[2]


def test_every_power_is_taken_apart_exactly(spark):
    xs = [math.ldexp(m, e) for e in range(-1074, 1024) for m in (1.0, 1.9999999999999998) if not math.isinf(m * 2.0 ** min(e, 1023))]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(c.alias(n) for c, n in zip(exact.parts(F.col("x")), ("power", "integer")))).collect()
    assert all(Fraction(r.integer) * Fraction(2) ** r.power == Fraction(r.x) for r in got)


def test_compensated_sums_in_order(spark):
    rng = random.Random(6)
    rows = [(k, r, rng.uniform(0, 1) * 10.0 ** rng.randint(-8, 8)) for k in range(20) for r in range(60)]
    seen = set()
    for n in (1, 7):
        rng.shuffle(rows)
        got = exact.ordered_sums(spark.createDataFrame(rows, "k int, r int, x double").repartition(n), ["k"], ["r"], {"x": F.col("x")}).collect()
        assert all(r.x == math.fsum(x for k, _, x in rows if k == r.k) for r in got)
        seen.add(tuple(sorted((r.k, r.x) for r in got)))
    assert len(seen) == 1


def test_unit_sums(spark):
    xs = [1 / k for k in range(1, 120)] + [0.0, 1.0, 2 / 3]
    high, low = exact.unit_sums(F.col("x"), F.col("c"))
    got = spark.createDataFrame([(x, k + 1) for k, x in enumerate(xs)], "x double, c long").agg(high.alias("h"), low.alias("l")).select(exact.unit_total(F.col("h"), F.col("l")).alias("t")).first().t
    assert got == float(sum(Fraction(x) * (k + 1) for k, x in enumerate(xs)))


def test_metrics_are_the_same_bits_over_any_partitions(spark, sf):
    rows = wide_codes(with_split(items(spark, sf))).cache()
    seen = set()
    for n in (1, 7, 64):
        shells = rank.nested_shells(rows.repartition(n, F.rand(n)))
        found = metrics.means(metrics.query_metrics(shells), "direction", "bits").orderBy("direction", "bits").collect()
        seen.add(str([tuple(r) for r in found]))
    assert len(seen) == 1


def test_one_pass_gives_the_shells_of_each_width(spark, sf):
    from bitloom.sources.items import codes

    s = with_split(items(spark, sf)).withColumn("labels", F.when(F.col("id") % 3 == 0, F.array(F.lit(70), F.col("label"))).otherwise(F.col("labels")))
    names = ["direction", "bits", "qid", "r", "n", "m"]
    one = {tuple(r[:6]): r[6] for r in rank.nested_shells(wide_codes(s)).select(*names, "g").collect()}
    each = {tuple(r[:6]): r[6] for r in rank.shells(*rank.directed(codes(s))).select(*names, "g").collect()}
    assert one.keys() == each.keys() and all(abs(one[k] - each[k]) < 1e-9 for k in one)
