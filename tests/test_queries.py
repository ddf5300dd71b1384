"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows that don't change."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from bitloom import plans

SF = "/root/testdata/sf0.001"
_spec = importlib.util.spec_from_file_location("compare", os.path.join(os.path.dirname(__file__), "..", "tools", "compare.py"))
compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = compare.table([tuple(r) for r in df.collect()], df.columns)
    assert got[1]
    if name in plans.ORACLES:
        cur = duck.execute(plans.ORACLES[name])
        assert got == compare.table(cur.fetchall(), [d[0] for d in cur.description])


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert plans.QUERIES.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()


def test_stream_resumes_without_loss_or_repeat(spark, tmp_path):
    from bitloom.streaming import chunks

    e = spark.read.parquet(f"{SF}/events.parquet").repartition(6)
    source, folder = str(tmp_path / "in"), f"file://{tmp_path}/out"
    e.where("event_id % 2 = 0").write.parquet(source)
    chunks.evaluate(spark, source, folder, files=2)
    half = chunks.totals(spark, folder).groupBy().sum("n").first()[0]
    e.where("event_id % 2 = 1").write.mode("append").parquet(source)
    chunks.evaluate(spark, source, folder, files=2)
    chunks.evaluate(spark, source, folder, files=2)
    assert half == e.where("event_id % 2 = 0").count() and chunks.totals(spark, folder).groupBy().sum("n").first()[0] == e.count()
