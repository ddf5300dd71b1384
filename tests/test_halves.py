"""Halves in the last place, and zeros: queries and SQL round them alike, to the bit."""

import duckdb
import pytest

from bitloom import plans


def both(spark, folder, name, tables):
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = plans.QUERIES[name](spark, str(folder))
    cur = con.execute(plans.ORACLES[name])
    names = [d[0] for d in cur.description]
    return sorted(repr([r[n] for n in names]) for r in df.collect()), sorted(repr(list(r)) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["head_summary", "relation_evidence"])
def test_shares_with_halves(spark, tmp_path, name):
    shares = [(23, 2560), (41, 2560), (51, 2560), (1, 8), (61, 64), (2, 16), (61, 64), (1, 32), (1, 80), (7, 80), (1, 32), (11, 80)]
    rows = [(o, p, 1, float(q), float(q)) for o, (n, t) in enumerate(shares) for p, q in ((1, n), (2 + o % 2, t - n))]  # an order and the next share one brand
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    part = spark.createDataFrame([(1, "Brand#11"), (2, "Brand#12"), (3, "Brand#13")], "p_partkey long, p_brand string")
    got, want = both(spark, tmp_path, name, {"lineitem": lines, "part": part})
    assert got and got == want


def test_means_next_to_zero(spark, tmp_path):
    rows = [(0, [-1e-6] * 64, 0), (1, [-2e-6] * 64, 0), (2, [0.015625] * 64, 1)]
    got, want = both(spark, tmp_path, "pooled_vectors", {"embeddings": spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")})
    assert got and got == want


def test_projections_hash_labels_not_rows(spark):
    plan = plans.QUERIES["posterior_projections"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    hashed = [line for line in plan.splitlines() if "sha2(" in line]
    assert hashed and not any("h1" in line for line in hashed)
