import json

import pytest
from pyspark.sql import functions as F

from bitloom.operators import ledger
from bitloom.sources import bundle

ROWS = 40


def clean(spark, bits=16):
    """A faultless bundle of 40 items: 8 queries, 32 in the gallery, 10 of which train."""
    x = spark.range(ROWS).select(F.col("id").alias("row"))
    code = lambda seed: F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(F.pmod(F.xxhash64(F.lit(seed), "row", i), F.lit(2)) == 0, 1).otherwise(-1).cast("tinyint"))
    hot = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.col("row") % 3 == i).cast("smallint"))
    index = lambda where: spark.createDataFrame([(k, v) for k, v in enumerate(n for n in range(ROWS) if where(n))], "row long, value long")
    said = {"rows": ROWS, "train_rows": 10, "query_rows": 8, "database_rows": 32, "bits": bits, "classes": 3}
    return {
        "image_codes": x.select("row", code("i").alias("value")), "text_codes": x.select("row", code("t").alias("value")), "labels": x.select("row", hot.alias("value")),
        "train_idx": index(lambda n: n % 4 == 1), "query_idx": index(lambda n: n % 5 == 0), "database_idx": index(lambda n: n % 5 != 0),
        "metadata": spark.createDataFrame([(json.dumps(said),)], "json string"),
    }


def fixed(b):
    """Items 5 and 25 are queries and would train: they don't."""
    return b | {"train_idx": b["train_idx"].where("value % 5 <> 0"), "metadata": b["metadata"].select(F.regexp_replace("json", '"train_rows": 10', '"train_rows": 8').alias("json"))}


def change(name, **at):
    return lambda b: b | {name: b[name].withColumns({c: F.expr(e) for c, e in at.items()})}


FAULTS = {
    "image_codes.domain": change("image_codes", value="if(row = 7, transform(value, x -> cast(0 as tinyint)), value)"),
    "text_codes.width": change("text_codes", value="if(row = 7, slice(value, 1, 15), value)"),
    "text_codes.null": change("text_codes", value="if(row = 7, null, value)"),
    "labels.domain": change("labels", value="if(row = 7, transform(value, x -> cast(3 as smallint)), value)"),
    "labels.none": change("labels", value="if(row = 7, transform(value, x -> cast(0 as smallint)), value)"),
    "labels.width": change("labels", value="if(row = 7, concat(value, value), value)"),
    "image_codes.id": lambda b: b | {"image_codes": b["image_codes"].unionAll(b["image_codes"].limit(1).selectExpr("cast(null as long)", "value"))},
    "image_codes.repeated": lambda b: b | {"image_codes": b["image_codes"].unionAll(b["image_codes"].where("row = 7"))},
    "image_codes.missing": lambda b: b | {"image_codes": b["image_codes"].where("row <> 7")},
    "text_codes.missing": lambda b: b | {"text_codes": b["text_codes"].where("row <> 7")},
    "labels.missing": lambda b: b | {"labels": b["labels"].where("row <> 7")},
    "query_idx.overlap": change("query_idx", value="if(row = 1, 7, value)"),
    "query_idx.repeated": change("query_idx", value="if(row = 1, 10, value)"),
    "query_idx.range": change("query_idx", value="if(row = 7, 400, value)"),
    "query_idx.order": change("query_idx", value="case row when 1 then 10 when 2 then 5 else value end"),
    "database_idx.uncovered": lambda b: b | {"database_idx": b["database_idx"].where("value <> 7")},
    "train_idx.query": change("train_idx", value="if(value = 9, 10, value)"),
    "train_idx.stray": change("train_idx", value="if(value = 9, 10, value)"),
    "metadata.rows": lambda b: b | {"metadata": b["metadata"].select(F.regexp_replace("json", '"rows": 40', '"rows": 41').alias("json"))},
    "metadata.bits": lambda b: b | {"metadata": b["metadata"].select(F.regexp_replace("json", '"bits": 16, ', "").alias("json"))},
}


@pytest.mark.parametrize("rule", FAULTS)
def test_every_fault_is_told(spark, rule):
    got = bundle.load(FAULTS[rule](fixed(clean(spark))))
    assert rule in {r.rule for r in got.violations.collect()}


@pytest.mark.parametrize("form", ["parquet", "npy"])
def test_a_clean_bundle_is_imported_as_it_is(spark, tmp_path, form):
    from bitloom.functions.codes import unpack

    whole = fixed(clean(spark))
    bundle.write(spark, whole, str(tmp_path), form)
    got = bundle.load(bundle.tables(spark, str(tmp_path), form))
    assert got.violations.count() == 0 and got.quarantined.count() == 0
    back = got.codes.select("id", "modality", unpack(F.col("code"), 16).alias("value")).collect()
    want = {(r.row, t.partition("_")[0]): list(r.value) for t in bundle.CODES for r in whole[t].collect()}
    assert {(r.id, r.modality): r.value for r in back} == want


def test_bad_items_are_kept_apart(spark):
    b = FAULTS["labels.none"](FAULTS["image_codes.id"](fixed(clean(spark))))
    got = bundle.load(b)
    assert {r.id for r in got.quarantined.collect()} == {7, None} and got.codes.count() == 2 * (ROWS - 1)
    assert all(r.broken == ["labels.none"] for r in got.quarantined.where("id = 7").collect())


def test_metadata_that_cannot_be_read(spark):
    b = fixed(clean(spark)) | {"metadata": spark.createDataFrame([("no json",)], "json string")}
    assert {f"metadata.{c}" for c in ("rows", "bits", "classes")} <= {r.rule for r in bundle.load(b).violations.collect()}


def test_each_table_is_read_once(spark, tmp_path):
    parts = {}
    for name in ("a", "b"):
        spark.range(100).write.parquet(str(tmp_path / name))
        parts[name] = ledger.Part(spark.read.parquet(str(tmp_path / name)), "id", {"odd": F.col("id") % 2 == 1})
    plan = ledger.violations(ledger.ledger(parts, {"a.alone": "a > 0 and b = 0"}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Join" not in plan


def test_seals_tell_what_happened(spark, tmp_path):
    df = spark.range(500).selectExpr("id", "concat('x', id % 50) as name", "if(id = 9, null, id / 7) as v").repartition(5)
    sealed = ledger.materialize(df, str(tmp_path / "a"))
    again = spark.read.parquet(str(tmp_path / "a"))
    assert sealed == ledger.seal(df.repartition(2)) and ledger.verify(again, sealed) == []
    assert ledger.verify(again.where("id <> 3"), sealed) == [("dropped", "one row", 1)]
    assert ledger.verify(again.unionAll(again.where("id = 3")), sealed) == [("doubled", "one row", 1)]
    assert ledger.verify(again.unionAll(spark.createDataFrame([(900, "x", None)], again.schema)), sealed) == [("added", "one row", 1)]
    assert ledger.verify(again.withColumn("name", F.when(F.col("id") == 4, "y").otherwise(F.col("name"))), sealed)[0][0] == "changed"
    assert ledger.verify(again.where("id > 20"), sealed)[0] == ("dropped", "rows, or others differ too", 21)
    empty = df.limit(0)
    assert ledger.seal(empty) == ledger.Seal(0, 0, 0) and ledger.verify(empty, ledger.Seal(0, 0, 0)) == []


def test_receipts_and_artifacts(spark):
    table = lambda *rows: spark.createDataFrame(rows, "shard int, n long, digest long").withColumn("digest", F.col("digest").cast("decimal(38,0)"))
    expected = table((1, 5, 10), (2, 5, 11), (3, 5, 12), (4, 5, 13), (4, 5, 13))
    found = table((1, 5, 10), (2, 5, 99), (4, 5, 13), (7, 1, 1))
    assert {tuple(r) for r in ledger.receipts_match(expected, found, "shard").collect()} == {(2, "differs"), (3, "lost"), (4, "repeated"), (7, "unknown")}


def test_order_without_a_window(spark):
    df = spark.createDataFrame([(0, 5), (1, 7), (2, 7), (3, 9), (4, 8), (6, 1)], "row long, value long").repartition(3)
    assert sorted(tuple(r) for r in ledger.out_of_order(df, "row", "value").collect()) == [(2, 7), (4, 8)]
