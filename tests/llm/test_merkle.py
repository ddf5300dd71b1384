import hashlib
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from bitloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(digests):
    """Plainly: the root, and the siblings of each leaf, level by level."""
    proofs, own, places = [[] for _ in digests], list(range(len(digests))), [[] for _ in digests]
    while len(digests) > 1:
        for k, at in enumerate(own):
            start = at - at % 8
            proofs[k].append("".join(digests[start:at] + digests[at + 1 : start + 8]))
            places[k].append(at % 8)
            own[k] = at // 8
        digests = [h(*digests[k : k + 8]) for k in range(0, len(digests), 8)]
    return digests[0], proofs, places


def plain(rows):
    """rows: (key, tree, digest) to {row's number: (subroot, root, proof, places)}."""
    order = sorted(range(len(rows)), key=lambda k: ((rows[k][1] or "").encode() if rows[k][1] is not None else b"", rows[k][1] is not None, rows[k][0] is not None, rows[k][0] or 0, rows[k][2]))
    order.sort(key=lambda k: (rows[k][1] is not None, (rows[k][1] or "").encode()))
    trees = [list(own) for _, own in groupby(order, key=lambda k: rows[k][1])]
    low = [climb([rows[k][2] for k in own]) for own in trees]
    root, proofs, places = climb([x[0] for x in low])
    return {k: (low[t][0], root, low[t][1][n] + proofs[t], low[t][2][n] + places[t]) for t, own in enumerate(trees) for n, k in enumerate(own)}


SCHEMA = "doc_id long, lang string, leaf string, k int, Proof int"


@pytest.mark.parametrize("sizes, height", [((1, 1), 3), ((0, 5, 8, 9), 3), ((70, 1, 600), 1), ((3, 1100, 64, 65, 63, 2, 1, 1, 1, 7, 8), 2), ((700,), 3)])
def test_proofs_against_a_plain_tree(spark, sizes, height):
    rng = random.Random(5)
    names = [None, "", "de", "en", "é", "日", "z", "A", "\U0001f600", "ab", "a"]
    rows = [(rng.randint(-500, 10**9) if rng.random() < 0.99 else None, names[t], h(str((t, k)))) for t, n in enumerate(sizes) for k in range(n)]
    rows += rows[:2]  # repeated rows
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, k, 0) for k, r in enumerate(rows)], SCHEMA).repartition(7)
    got = merkle.manifest(df, height=height)
    assert got.columns == ["doc_id", "lang", "leaf", "k", "subroot", "root", "proof", "places"]
    got = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"), F.col("places"))).withColumn("off", merkle.fold(F.sha2("leaf", 256), F.col("proof"), F.col("places"))).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    key = lambda leaf, found: (leaf, *found)  # noqa: E731  equal rows are told apart by place alone
    assert sorted(key(r.leaf, (r.subroot, r.root, r.proof, r.places)) for r in got) == sorted(key(rows[k][2], w) for k, w in want.items())
    assert all(r.folded == r.root and r.off != r.root for r in got)


def test_a_leaf_tells_fields_apart(spark):
    rows = [(None, "x"), ("", "x"), ("-", "x"), ("x", None), ("1:x", ""), ("é", "long " * 50_000)]
    got = spark.createDataFrame(rows, "a string, b string").select(merkle.leaf(F.col("a"), F.col("b")).alias("d")).collect()
    said = lambda v: "-" if v is None else f"{len(v.encode())}:{v}"
    assert [r.d for r in got] == [h(*map(said, r)) for r in rows] and len({r.d for r in got}) == len(rows)


def test_an_empty_table(spark):
    got = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and "root" in got.columns


def test_the_query_finds_what_was_changed(spark, sf):
    from bitloom.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op13_merkle_manifest"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    from zlib import crc32

    for d in docs:
        changed = crc32(str(d.doc_id).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in d.text or "")
        assert got[d.doc_id].verified == (not changed)
