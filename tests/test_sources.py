import json
import random

import pytest
from pyspark.sql import functions as F

from bitloom.operators import gate, metrics, rank
from bitloom.sources import adapters, readers, sinks
from bitloom.sources.items import codes, items, with_split

SF = "/root/testdata/sf0.001"


def test_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\n\nc\n")
    assert [(r.line_no, r.line) for r in readers.lines(spark, str(tmp_path / "t.txt")).collect()] == [(0, "a"), (1, ""), (2, "c")]
    import hashlib

    def record(a, b):
        body = json.dumps({"a": a, "b": b}, separators=(",", ":"))
        return {"a": a, "b": b, "sha256": hashlib.sha256(body.encode()).hexdigest()}

    good, bad = record(1, "x"), record(2, "y") | {"b": "z"}
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, (good, bad))))
    got = readers.event_log(spark, str(tmp_path / "e.json"), "a int, b string", ["a", "b"]).orderBy("a").collect()
    assert [r.valid for r in got] == [True, False]
    (tmp_path / "bad.json").write_text('{"a": 1}\n{"a": ')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "bad.json"), "a int").collect()


def test_shards_and_violations(spark, tmp_path):
    df = spark.range(0, 100).select(F.col("id").cast("string").alias("row_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    assert readers.shard_violations(df, 2).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 2.0]), ("a", None), ("b", [1.0]), ("c", [float("nan"), 1.0]), ("d", [1.0, 1.0]), ("d", [1.0, 1.0])], "row_id string, vector array<float>")
    assert sorted(r.reason for r in readers.shard_violations(odd, 2).collect()) == ["no id", "no vector", "not finite", "repeated", "width"]
    path = str(tmp_path / "s")
    sinks.shards(df, path, "row_id", 4)
    back = spark.read.parquet(path)
    r = sinks.receipts(back, "row_id")
    assert back.count() == 100 and r.count() == 4
    assert {x.shard: x.digest for x in r.collect()} == {x.shard: x.digest for x in sinks.receipts(back.repartition(7), "row_id").collect()}
    expected = spark.range(0, 6).select(F.col("id").cast("int").alias("shard"))
    assert sorted(x.shard for x in sinks.unfinished(expected, r, "shard").collect()) == [4, 5]
    sinks.csv(df.select("row_id"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 100


def test_adapters(spark):
    mk = spark.createDataFrame
    got = adapters.adapter("Indexed")(mk([(0, "p"), (2, "q")], "raw_index int, source_id string"), mk([(0, 1, "sea"), (0, 0, "sky"), (1, 0, "x")], "raw_index int, position int, tag string"), mk([(0, 3), (0, 1)], "raw_index int, label int"))
    assert {r.source_id: (r.texts, r.labels) for r in got.collect()} == {"p": (["sky", "sea"], [1, 3]), "q": ([adapters.FALLBACK], [])}
    ims, caps, cats = mk([(1,), (2,), (3,)], "image_id int"), mk([(1, 9, "b"), (1, 8, "a"), (2, 7, "c")], "image_id int, caption_id int, caption string"), mk([(1, 5), (3, 5)], "image_id int, label int")
    got = adapters.adapter("cap-tioned")([ims, mk([(4,)], "image_id int")], [caps, mk([(4, 1, "d")], caps.schema)], [cats, mk([(4, 2)], cats.schema)])
    assert {r.source_id: (r.texts, r.labels) for r in got.collect()} == {1: (["a", "b"], [5]), 4: (["d"], [2])}
    got = adapters.adapter(" tagged ")(mk([(1, "cat"), (1, "zzz"), (2, "zzz")], "photo_id int, tag string"), mk([("cat",)], "tag string"), mk([(1, 4)], "photo_id int, label int"))
    assert [tuple(r) for r in got.collect()] == [(1, ["a photo of cat"], [4])]
    with pytest.raises(ValueError, match="captioned, indexed, tagged"):
        adapters.adapter("other")


def test_labels_open_after_ranks_are_frozen(spark):
    s = codes(with_split(items(spark, SF))).where("bits = 16")
    q, d = rank.directed(s)
    with pytest.raises(ValueError):
        gate.freeze(q, d)
    frozen = gate.freeze(q.drop("qlabel", "qlabels"), d.drop("dlabel", "dlabels"))
    assert frozen.digest == gate.freeze(q.drop("qlabel", "qlabels").repartition(3), d.drop("dlabel", "dlabels")).digest
    with pytest.raises(TypeError):
        gate.measure(frozen.ranks, s)
    with pytest.raises(ValueError, match="not those"):
        gate.measure(gate.Frozen(frozen.ranks.withColumn("r", F.col("r") + 1), frozen.digest), s)
    one = metrics.means(metrics.query_metrics(gate.measure(frozen, items(spark, SF))), "direction").collect()
    two = metrics.means(metrics.query_metrics(rank.shells(q, d)), "direction").collect()
    key = lambda r: r.direction
    for a, b in zip(sorted(one, key=key), sorted(two, key=key)):
        assert all(x == y if isinstance(x, str) else abs(x - y) < 1e-12 for x, y in zip(a, b))


def test_line_numbers_over_many_splits(spark, tmp_path):
    """Splits of some bytes cut lines, characters and line ends; numbers are those of a plain reader."""
    rng = random.Random(2)
    for name in "abc":
        parts = ["".join(rng.choices("aé日\U0001f600 ", k=rng.randint(0, 60))) + rng.choice(["\n", "\r\n", "\n"]) for _ in range(rng.randint(300, 900))]
        (tmp_path / f"{name}.txt").write_bytes("".join(parts).encode() + (b"no end" if name == "b" else b""))
    (tmp_path / "empty.txt").write_bytes(b"")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = readers.lines(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 50
        got = found.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {(name, k): line for name in "abc" for k, line in enumerate((tmp_path / f"{name}.txt").read_bytes().decode().replace("\r\n", "\n").removesuffix("\n").split("\n"))}
    assert len(got) == len(want) and {(r.file[-5], r.line_no): r.line for r in got} == want
    file = next(r.file for r in got if r.file[-5] == "b")
    spots = spark.createDataFrame([(file, 0), (file, 250), (file, 10**6), ("other", 0)], "file string, line_no long")
    assert {(r.file[-5:], r.line_no): r.line for r in readers.located(found, spots).collect()} == {("b.txt", 0): want["b", 0], ("b.txt", 250): want["b", 250], ("b.txt", 10**6): None, ("other", 0): None}


def test_sets_and_posteriors_that_are_none(spark):
    from bitloom.functions import labels

    df = spark.createDataFrame([([0, 2],), ([],)], "ids array<int>")
    assert [r.h for r in df.select(labels.strict_multi_hot(F.col("ids"), 3).alias("h")).collect()] == [[1, 0, 1], [0, 0, 0]]
    for bad in ([1, 1], [3], [-1], [None]):
        with pytest.raises(Exception, match="not a set of ids below 3"):
            spark.createDataFrame([(bad,)], "ids array<int>").select(labels.strict_multi_hot(F.col("ids"), 3)).collect()
    rows = [([0.0, 1.0], None), ([0.5], "width"), (None, "null"), ([0.5, None], "not finite"), ([0.5, float("nan")], "not finite"), ([0.5, 1.1], "outside"), ([-0.1, 1.0], "outside")]
    assert all(r.f == r.want for r in spark.createDataFrame(rows, "p array<double>, want string").select("want", labels.unit_faults(F.col("p"), 2).alias("f")).collect())


def test_a_split_that_differs(spark):
    from bitloom.plans.collections import split_faults

    schema = "id long, is_q boolean, is_t boolean, is_d boolean"
    own = spark.createDataFrame([(k, k % 5 == 0, k % 5 == 1, k % 5 != 0) for k in range(20)], schema)
    assert split_faults(own, own).count() == 0
    stored = own.where("id <> 3").unionAll(own.where("id = 4")).unionAll(spark.createDataFrame([(99, False, False, False)], schema))
    stored = stored.withColumn("is_t", F.when(F.col("id") == 6, False).otherwise(F.col("is_t")))
    assert {tuple(r) for r in split_faults(stored, own).collect()} == {("missing", 1, 3), ("repeated", 1, 4), ("unknown", 1, 99), ("neither", 1, 99), ("is_t", 1, 6)}


def test_faults_of_indexed_collections(spark):
    mk = spark.createDataFrame
    rows = mk([(0, "a"), (1, None), (1, "b")], "raw_index long, source_id string")
    tags = mk([(0, 0, "x"), (0, 2, "y"), (7, 0, "z"), (1, 0, "p"), (1, 1, "q")], "raw_index long, position int, tag string")
    labels = mk([(0, 1), (8, None)], "raw_index long, label int")
    got = {tuple(r) for r in adapters.index_faults(rows, tags, labels).collect()}
    assert got == {("rows.name", 1, 1), ("rows.repeated", 1, 1), ("tags.positions", 1, 0), ("tags.stray", 1, 7), ("labels.stray", 1, 8), ("labels.null", 1, 8)}
