"""Bundles of codes from an outside tool: seven tables that are checked together, packed, and quarantined row by row.

image_codes, text_codes and labels have (row, value): an item's number and its bipolar code or multi-hot labels. train_idx, query_idx and
database_idx have (row, value): a place and the item that stands there. metadata has one row (json): the numbers that the bundle claims.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import pack
from ..operators.ledger import Part, ledger, out_of_order, split_off, violations
from ..session import settled
from . import arrays

CODES, INDEXES = ("image_codes", "text_codes"), ("train_idx", "query_idx", "database_idx")
_SCHEMAS = {**dict.fromkeys(CODES, "row long, value array<tinyint>"), "labels": "row long, value array<smallint>", **dict.fromkeys(INDEXES, "row long, value long"), "metadata": "json string"}
#: Sizes in the metadata, and the tables that have to have so many rows.
_CLAIMS = {"rows": ("image_codes", "text_codes", "labels"), "train_rows": ("train_idx",), "query_rows": ("query_idx",), "database_rows": ("database_idx",)}
ACROSS = {
    **{f"{t}.repeated": f"{t} > 1" for t in (*CODES, "labels", *INDEXES)},
    **{f"{t}.missing": f"{t} = 0 and {' + '.join(x for x in (*CODES, 'labels', *INDEXES) if x != t)} > 0" for t in (*CODES, "labels")},
    "query_idx.overlap": "query_idx > 0 and database_idx > 0",
    "train_idx.query": "train_idx > 0 and query_idx > 0",
    "train_idx.stray": "train_idx > 0 and database_idx = 0",
    "database_idx.uncovered": "image_codes > 0 and query_idx + database_idx = 0",
}


@dataclass
class Imported:
    """codes (id, modality, bits, code) and roles of the items that break nothing; the others with `broken`; and what is broken in all."""

    codes: DataFrame
    quarantined: DataFrame
    violations: DataFrame


def tables(spark: SparkSession, folder: str, form: str = "parquet") -> dict[str, DataFrame]:
    """The bundle in `folder`; form: parquet, or npy (a file or folder NAME.npy for each array; metadata is a text file either way)."""
    if form == "npy":
        arrays.register(spark)
    at = lambda t: f"{folder}/{t}" + (".npy" if form == "npy" else "")
    found = {t: spark.read.format(form).schema(s).load(at(t)) for t, s in _SCHEMAS.items() if t != "metadata"}
    return found | {"metadata": spark.read.text(f"{folder}/metadata", wholetext=True).withColumnRenamed("value", "json")}


def write(spark: SparkSession, bundle: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Writes a bundle's tables as `tables` reads them; arrays as NPY have their rows by number, so numbers have to be 0, 1, 2..."""
    if form == "npy":
        arrays.register(spark)
    for t, df in bundle.items():
        if t == "metadata":
            df.coalesce(1).write.mode("overwrite").text(f"{folder}/{t}")
        elif form == "npy":
            df.repartitionByRange("row").sortWithinPartitions("row").select("value").write.format("npy").mode("overwrite").save(f"{folder}/{t}.npy")
        else:
            df.select("row", "value").write.mode("overwrite").parquet(f"{folder}/{t}")


def load(bundle: dict[str, DataFrame]) -> Imported:
    """Checks a bundle, packs its codes, and keeps what breaks a rule apart.

    Every table is read once for the checks, and index tables once more for their order. A claim that is not met, an order that is not
    ascending and metadata that cannot be read belong to the bundle, not to an item: they stand in `violations` alone.
    """
    claims = ", ".join(f"{c} long" for c in (*_CLAIMS, "bits", "classes"))
    read = bundle["metadata"].select(F.from_json("json", claims).alias("m")).select("m.*").limit(2).collect()  # one row
    said = read[0].asDict() if len(read) == 1 else {}
    said = {k: said.get(k) for k in (*_CLAIMS, "bits", "classes")}
    size, null = F.size("value"), F.col("value").isNull()
    odd = lambda *good: F.exists("value", lambda x: x.isNull() | ~x.isin(*good))
    wide = lambda n: F.lit(False) if said[n] is None else size != said[n]
    beyond = F.lit(False) if said["rows"] is None else (F.col("value") < 0) | (F.col("value") >= said["rows"])
    parts = {t: Part(bundle[t], "row", {"null": null, "domain": odd(-1, 1), "width": wide("bits")}) for t in CODES}
    parts["labels"] = Part(bundle["labels"], "row", {"null": null, "domain": odd(0, 1), "width": wide("classes"), "none": ~F.exists("value", lambda x: x > 0)})
    parts |= {t: Part(bundle[t], "value", {"range": beyond}) for t in INDEXES}
    checked = settled(ledger(parts, ACROSS))
    counts = checked.agg(*(F.coalesce(F.sum(F.col("n")[t]), F.lit(0)).alias(t) for t in parts)).first()
    met = [(f"metadata.{c}", counts[t], None) for c, ts in _CLAIMS.items() for t in ts if said[c] is not None and said[c] != counts[t]]
    met += [(f"metadata.{c}", 0, None) for c, v in said.items() if v is None]
    spark = checked.sparkSession
    all_ = violations(checked).unionAll(spark.createDataFrame(met, "rule string, ids long, example long"))
    for t in INDEXES:
        all_ = all_.unionAll(out_of_order(bundle[t], "row", "value").agg(F.count("*").alias("ids"), F.min("row").alias("example")).where("ids > 0").select(F.lit(f"{t}.order"), "ids", "example"))
    sides = [bundle[t].select(F.col("row").alias("id"), F.lit(t.partition("_")[0]).alias("modality"), F.size("value").alias("bits"), pack(F.col("value")).alias("code")) for t in CODES]
    good, bad = split_off(reduce(DataFrame.unionAll, sides), "id", checked)
    return Imported(good, bad, all_)
