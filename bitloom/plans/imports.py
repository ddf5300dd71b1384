"""Queries over files that outside tools exchange: arrays, and bundles of codes with a manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from ..sources import arrays, bundle, sparse
from ..sources.tables import table
from ..streaming.chunks import shared_folder
from .registry import CODES, query


@query("SELECT vec_id, label, len(embedding)::INTEGER AS width, round(list_sum([x::DOUBLE FOR x IN embedding]), 5) AS total, embedding[1]::DOUBLE AS first FROM embeddings")
def array_rows(spark, sf_dir):
    """The embeddings written as NPZ archives of three arrays, and read back in row ranges."""
    arrays.register(spark)
    folder = shared_folder(spark)
    table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").write.format("npz").mode("overwrite").option("rows", 300).save(folder)
    found = spark.read.format("npz").option("rows", 100).schema("vec_id long, label int, embedding array<float>").load(folder)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return found.select("vec_id", "label", F.size("embedding").alias("width"), F.round(total, 5).alias("total"), F.get("embedding", F.lit(0)).cast("double").alias("first"))


#: Faults of a bundle by the item's number modulo 50; the rest of it is as the library's own codes, split and labels have it.
_FAULTS = {
    "image_codes.domain": "IN (1)", "text_codes.width": "IN (2)", "image_codes.repeated": "IN (3)", "text_codes.missing": "IN (4)", "labels.missing": "IN (5)",
    "labels.none": "IN (6)", "labels.domain": "IN (7)", "query_idx.overlap": "IN (8)", "database_idx.uncovered": "IN (9)", "train_idx.stray": "IN (9, 10, 20)", "train_idx.query": "IN (10, 20)",
    "image_codes.null": "IN (11)",
}


def faulty_bundle(spark, sf_dir):
    """The 32-bit codes of all items as a bundle in which every fiftieth item has one fault of each kind."""
    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), "label", F.slice("embedding", 1, 32).alias("image"), F.slice("embedding", 33, 32).alias("text"))
    x = x.withColumn("k", F.pmod("row", F.lit(50)))
    signs = lambda c: F.transform(c, lambda v: F.when(v >= 0, 1).otherwise(-1).cast("tinyint"))
    one = lambda v: F.array(F.lit(v).cast("tinyint"))
    image = F.when(F.col("k") == 1, F.concat(one(0), F.slice(signs("image"), 2, 31))).when(F.col("k") == 11, F.lit(None)).otherwise(signs("image"))
    text = F.when(F.col("k") == 2, F.concat(signs("text"), one(1))).otherwise(signs("text"))
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), F.when(F.col("k") == 6, 0).when(F.col("k") == 7, 2).otherwise(1)).otherwise(0).cast("smallint"))
    is_q = (F.col("row") % 10 == 0) | (F.col("k") == 8)
    is_d = ((F.col("row") % 10 != 0) | (F.col("k") == 8)) & (F.col("k") != 9)
    is_t = F.col("k").isin(9, 10, 12, 13, 20)
    index = lambda flag, *swapped: x.where(flag).select("row", (F.when(F.col("k") == swapped[0], F.col("row") + 1).when(F.col("k") == swapped[1], F.col("row") - 1).otherwise(F.col("row")) if swapped else F.col("row")).alias("value"))
    claims = x.agg(F.count("*").alias("rows"), F.count_if(is_t).alias("train_rows"), F.count_if(is_q).alias("query_rows"), (F.count_if(is_d) + 1).alias("database_rows"), F.lit(32).alias("bits"), F.lit(10).alias("classes"))
    return {
        "image_codes": x.select("row", image.alias("value"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy"),
        "text_codes": x.where("k <> 4").select("row", text.alias("value")), "labels": x.where("k <> 5").select("row", hot.alias("value")),
        "train_idx": index(is_t, 12, 13), "query_idx": index(is_q), "database_idx": index(is_d), "metadata": claims.select(F.to_json(F.struct("*")).alias("json")),
    }


_COUNTED = " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS ids, min(vec_id) AS example FROM e WHERE k {of}" for r, of in _FAULTS.items())
_OF = lambda k: f"(SELECT count(*) FROM e WHERE k IN ({k}))"


@query(
    f"WITH e AS (SELECT vec_id, vec_id % 50 AS k FROM embeddings), n AS (SELECT count(*) AS n FROM e), v AS ({_COUNTED} UNION ALL SELECT 'train_idx.order', count(*), min(vec_id) FROM e WHERE k = 13 "
    f"UNION ALL SELECT 'metadata.rows', n + {_OF(3)}, NULL FROM n UNION ALL SELECT 'metadata.rows', n - {_OF(4)}, NULL FROM n UNION ALL SELECT 'metadata.rows', n - {_OF(5)}, NULL FROM n "
    "UNION ALL SELECT 'metadata.database_rows', count(*), NULL FROM e WHERE (vec_id % 10 <> 0 OR k = 8) AND k <> 9) SELECT * FROM v WHERE ids > 0"
)
def bundle_violations(spark, sf_dir):
    """A faulty bundle is written, read and checked: every kind of fault with the number of items that have it and the first of them."""
    folder = shared_folder(spark)
    bundle.write(spark, faulty_bundle(spark, sf_dir), folder)
    return bundle.load(bundle.tables(spark, folder)).violations


@query(f"WITH {CODES}, good AS (SELECT id, modality, lo FROM codes WHERE bits = 32 AND id % 50 NOT IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 20)) SELECT id, modality, 32 AS bits, lo AS code FROM good")
def imported_codes(spark, sf_dir):
    """The codes of that bundle's faultless items: packed from outside bipolar rows, they are the library's own."""
    folder = shared_folder(spark)
    bundle.write(spark, faulty_bundle(spark, sf_dir), folder)
    return bundle.load(bundle.tables(spark, folder)).codes


@query(
    "WITH c AS (SELECT l_partkey AS p, l_suppkey % 50 AS k, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) "
    "SELECT p_partkey AS row, list(coalesce(v, 0) ORDER BY i) AS vector FROM part CROSS JOIN range(10, 30) r(i) LEFT JOIN c ON p = p_partkey AND k = i GROUP BY p_partkey"
)
def sparse_rows(spark, sf_dir):
    """Quantities of each part by supplier group as a sparse matrix in rows, and columns 10 to 30 of all its rows made dense."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("row"), (F.col("l_suppkey") % 50).alias("column")).agg(F.sum("l_quantity").alias("value"))
    found = sparse.entries(*sparse.csr(cells))
    return sparse.dense(found, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row")), 10, 30)


@query(
    "SELECT unnest(['clean', 'one dropped', 'one doubled', 'one changed', 'customer dropped']) AS copy, unnest(['-', 'dropped', 'doubled', 'changed', 'dropped']) AS kind, "
    "unnest([0, 1, 1, 0, (SELECT count(*) FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders))])::BIGINT AS n"
)
def sealed_orders(spark, sf_dir):
    """Orders written and sealed in one pass, then copies with one fault each held against the seal: what is found of each."""
    folder = shared_folder(spark)
    sealed = ledger.materialize(table(spark, sf_dir, "orders"), folder)
    written = spark.read.parquet(folder)
    first = written.agg(F.min("o_orderkey"), F.min("o_custkey")).first()
    one = F.col("o_orderkey") == first[0]
    copies = {
        "clean": written, "one dropped": written.where(~one), "one doubled": written.unionAll(written.where(one)),
        "one changed": written.withColumn("o_totalprice", F.when(one, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))), "customer dropped": written.where(F.col("o_custkey") != first[1]),
    }
    told = [(name, *((found[0][0], found[0][2]) if (found := ledger.verify(df, sealed)) else ("-", 0))) for name, df in copies.items()]
    return spark.createDataFrame(told, "copy string, kind string, n long")
