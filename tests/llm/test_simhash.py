import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bitloom.llm import simhash
from bitloom.llm.common import join_unevenly
from bitloom.llm.graph import components

SCHEMA = "doc_id long, text string, fp string, component_id long"


def plain_print(text):
    words = bytes((text or "").encode()).lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return {x: min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i, x in enumerate(ids)}


def test_query_equals_brute_force(spark, sf):
    from bitloom.llm.queries import QUERIES

    got = QUERIES["op7_simhash_near_dedup"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    prints = dict(zip(docs.doc_id, map(plain_print, docs.text)))
    assert {r.doc_id: int(r.fingerprint, 16) for r in got.itertuples()} == prints
    want = plain_components(list(prints), list(prints.values()))
    assert dict(zip(got.doc_id, got.component_id)) == want


@pytest.mark.parametrize("limit", [2, 5, 4096])
def test_links_join_what_all_pairs_join(spark, limit):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6)
    prints = set()
    for b in base:
        for _ in range(60):
            x = int(b)
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(bit)
            prints.add(x - (1 << 64) if x >= 1 << 63 else x)
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(3)
    roots = {r.node: r.root for r in components(simhash.links(df, limit)).collect()}
    want = plain_components(prints, [p & (2**64 - 1) for p in prints])
    got = {p: roots.get(p, p) for p in prints}
    assert got == want


def test_a_key_of_many_is_dealt_before_its_rows_meet(spark):
    rng = np.random.default_rng(6)
    low = 0x12345678
    prints = sorted({int(x) << 32 | low for x in rng.integers(0, 2**31, 6000)} | {int(x) << 32 | low ^ 1 for x in rng.integers(0, 2**31, 3000)})
    prints = sorted({*prints, *(p ^ (1 << 40) for p in prints[::9]), *(p ^ (1 << 3) ^ (3 << 50) for p in prints[1::9])})
    df = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(4)
    whole = simhash.variants(df).groupBy("key").count().where("count > 512").select("key")
    struck = "explode(transform(sequence(0, 32), b -> (half - shiftleft(cast(32 - b as bigint), 32)) & ~(if(b = 32, 0L, shiftleft(1L, b))))) as key"
    assert whole.count() > 30 and whole.join(simhash.crowded(df, 512).selectExpr(struck), "key", "left_anti").isEmpty()
    a, b = (components(simhash.links(df, limit)).orderBy("node").collect() for limit in (512, 1 << 20))
    assert a == b and len(a) > 1500


def test_joins_of_crowds(spark):
    rows = spark.range(1000).selectExpr("id", "if(id < 600, 7, id) as fp")
    one = rows.groupBy("fp").count().withColumnRenamed("count", "copies").withColumn("name", F.col("fp") * 2)
    got = join_unevenly(rows, one, "fp", "copies", 100)
    assert sorted((r.id, r.name) for r in got.collect()) == [(i, 14 if i < 600 else 2 * i) for i in range(1000)]


def test_one_each_keeps_user_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, 6, 7), (2, "a b c d", 8, 9, 10)], "doc_id long, text string, __own_id int, fp int, `a``b` int")
    got = simhash.one_each(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, "a b c d", 5, 6, 7)]


def test_odd_rows(spark):
    rows = [(5, None, "x", 1), (6, "", "x", 1), (7, "a b c d", "x", 1), (7, "a b c d", "x", 1), (None, "A B c  d", None, None), (9, "word " * 50_000, None, 2)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[5] == by[6] == {5} and by[7] == {7} and by[None] == {7} and by[9] == {9}


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spark_xxhash_agrees(spark):
    got = spark.createDataFrame([("añb c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest("añb c".encode(), 42)
