"""Sparse matrices in rows (CSR) as tables of dense slices.

A matrix is three tables: indptr (place, value), whose value at place i is where row i begins among the entries, and indices and data
(place, value). Rows become ranges of entries; entries find their row by the block of places they lie in, so that a row of any length is
spread over its blocks, and nothing is dense before it is sliced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places of a block.
BLOCK = 4096


def entries(indptr: DataFrame, indices: DataFrame, data: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, column, value): the entries of a matrix, each met with its row by block and range. Rows without entries give none."""
    both = indptr.select(F.explode(F.array(F.struct(F.col("place").alias("row"), F.col("value").alias("lo"), F.lit(None).cast("long").alias("hi")), F.struct((F.col("place") - 1).alias("row"), F.lit(None).cast("long").alias("lo"), F.col("value").alias("hi")))).alias("x"))
    rows = both.groupBy("x.row").agg(F.max("x.lo").alias("lo"), F.max("x.hi").alias("hi")).where("row >= 0 and lo < hi")
    spread = rows.select("row", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))).alias("block"))
    cells = indices.select("place", F.col("value").alias("column")).join(data.select("place", "value"), "place").withColumn("block", F.floor(F.col("place") / block))
    return cells.join(spread, "block").where("place >= lo and place < hi").select("row", "column", "value")


def dense(found: DataFrame, rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """(row, vector): columns `lo` to `hi` of each of `rows` (row); entries at the same place add up, rows without entries are zeros."""
    width = hi - lo
    own = found.where((F.col("column") >= lo) & (F.col("column") < hi)).groupBy("row", "column").agg(F.sum("value").alias("value"))
    packed = own.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct((F.col("column") - lo).cast("int"), "value"))).alias("at"))  # at most `width` entries
    at = F.coalesce("at", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>")))
    return rows.select("row").join(packed, "row", "left").select("row", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0.0))).alias("vector"))


def csr(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(indptr, indices, data) of cells (row, column, value), for all rows from 0 to the greatest, empty ones too.

    Rows are counted by blocks of BLOCK, so that what one window runs over is a row for each block.
    """
    most = cells.agg(F.max("row")).first()[0]
    counts = cells.groupBy("row").agg(F.count("*").alias("n"))
    counts = cells.sparkSession.range(0 if most is None else most + 1).withColumnRenamed("id", "row").join(counts, "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    part = F.floor(F.col("row") / BLOCK)
    sums = counts.groupBy(part.alias("part")).agg(F.sum("n").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row for BLOCK rows
    starts = counts.withColumn("part", part).join(before, "part").withColumn("lo", F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("row")) - F.col("n"))
    last = starts.agg((F.max("row") + 1).alias("place"), F.sum("n").alias("value")).where("place is not null")
    indptr = starts.select(F.col("row").alias("place"), F.col("lo").alias("value")).unionAll(last)
    placed = cells.join(starts.select("row", "lo"), "row").withColumn("place", F.col("lo") + F.row_number().over(Window.partitionBy("row").orderBy("column")) - 1)
    return indptr, placed.select("place", F.col("column").alias("value")), placed.select("place", "value")
