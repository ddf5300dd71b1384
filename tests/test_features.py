"""Closed-form fits against numpy over the collected table; pointers and forms of JSON."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import text
from bitloom.plans import features

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding", "label").collect()
    return np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])


def test_principal_axes(spark, data):
    x, _ = data
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    got = features.principal_axes(spark, SF).toPandas()
    for axis in range(8):
        own = got[got.axis == axis].sort_values("dim")
        want = vectors[:, -1 - axis]
        want = want * np.sign(want[np.argmax(np.abs(want))])
        assert np.allclose(own.variance, values[-1 - axis]) and np.allclose(own.weight, want, atol=1e-6)


def test_ridge_labels(spark, data):
    x, y = data
    names = np.unique(y)
    one = (y[:, None] == names).astype(float)
    centred = x - x.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + np.eye(x.shape[1]), centred.T @ (one - one.mean(axis=0)))
    scores = centred @ w + one.mean(axis=0)
    want = {}
    for a, b in zip(y.tolist(), names[scores.argmax(axis=1)].tolist()):
        want[a, b] = want.get((a, b), 0) + 1
    got = {(r.label, r.predicted): r.n for r in features.ridge_labels(spark, SF).collect()}
    assert got == want


def test_json_pointers_read_digits_both_ways(spark):
    df = spark.createDataFrame([('{"0": "a", "x": ["p", "q"], "m~n": {"a/b": 3}, "01": 4}',)], "d string")
    ask = lambda p: df.select(text.json_pointer(df.d, p).alias("v")).first().v
    assert [ask(p) for p in ("/0", "/x/1", "/m~0n/a~1b", "/01", "/x/7", "/none")] == ["a", "q", "3", "4", None, None]
    with pytest.raises(ValueError, match="quote"):
        text.json_pointer(df.d, "/it's \"so\"")


def test_pointers_of_the_rfc(spark):
    document = r"""{"foo": ["bar", "baz"], "": 0, "a/b": 1, "c%d": 2, "e^f": 3, "g|h": 4, "i\\j": 5, "k\"l": 6, " ": 7, "m~n": 8, "it's": 9, "no": null}"""
    df = spark.createDataFrame([(document,)], "d string")
    want = {"/foo/0": "bar", "/foo/1": "baz", "/foo/2": None, "/": "0", "/a~1b": "1", "/c%d": "2", "/e^f": "3", "/g|h": "4", '/k"l': "6", "/ ": "7", "/m~0n": "8", "/it's": "9", "/no": None, "/foo": '["bar","baz"]'}
    got = df.select(*(text.json_pointer(df.d, p).alias(str(k)) for k, p in enumerate(want))).first()
    assert list(got) == list(want.values())
    assert df.select(text.json_pointer(df.d, "").alias("v")).first().v == df.select(text.canonical(df.d).alias("v")).first().v
    with pytest.raises(ValueError):
        text.json_pointer(df.d, "foo")


def test_one_text_for_any_order_of_keys(spark):
    import json

    rng = random.Random(1)

    def shuffled(v):
        if isinstance(v, dict):
            items = list(v.items())
            rng.shuffle(items)
            return {k: shuffled(x) for k, x in items}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    whole = {"b": {"z": [1, {"y": 2, "x": None}], "a": "é\"q"}, "": True, "a/b": 1.5, "A": {}, "l": []}
    rows = [(json.dumps(shuffled(whole), indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5),) for _ in range(30)]
    got = {r.v for r in spark.createDataFrame(rows, "d string").select(text.canonical(F.col("d")).alias("v")).collect()}
    assert len(got) == 1 and json.loads(got.pop()) == whole
    bad = ['{"a":1,"a":2}', "{", None, "NaN"]
    assert [r.v for r in spark.createDataFrame([(x,) for x in bad], "d string").select(text.canonical(F.col("d")).alias("v")).collect()] == [None] * 4
