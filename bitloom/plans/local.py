"""Queries with stateful per-row work: the local partial order, and subsets of rows for heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..operators import local_order
from ..operators.subbag import subbag, threshold
from ..sources.items import items, with_split
from ..sources.tables import table
from .registry import query

#: How far a score's interval reaches to each side, by the spread of its relevance.
WIDEN = 0.8

@query()
def local_partial_order(spark, sf_dir):
    """The first 64 rows of each image query by 16-bit distance, refined by cosines of parts of the vectors as heads.

    A score's interval has the spread of its heads as width, so that rows of different distances can overlap.
    """
    s = with_split(items(spark, sf_dir))
    side = lambda on, half: s.where(on).select("id", C.code(F.col(half), 16).alias("code"), F.col(half).alias("v"))

    def intervals(found):
        rows = found.select("qid", "did", (-F.col("r").cast("double")).alias("score"), F.array("r1", "r2").alias("relevance"), F.array("g1", "g2").alias("graded"))
        spread = (F.array_max("relevance") - F.array_min("relevance")) * WIDEN
        return rows.select("qid", "did", "score", (F.col("score") - spread).alias("low"), (F.col("score") + spread).alias("high"), "relevance", "graded")

    return local_order.decode_all(side("is_q", "image"), side("is_d", "text"), intervals, 64, widen=WIDEN)


@query(
    f"WITH h AS (SELECT vec_id, [sha256(concat_ws(chr(0), 'subbag-v1', '17', i::VARCHAR, vec_id::VARCHAR))[1:16] FOR i IN range(0, 4)] AS hs FROM embeddings), "
    f"b AS (SELECT hs, list_sum([CASE WHEN hs[i + 1] < '{threshold(0.8)}' THEN 1::BIGINT << i ELSE 0 END FOR i IN range(0, 4)]) AS drawn FROM h) "
    "SELECT (CASE WHEN drawn > 0 THEN drawn ELSE 1::BIGINT << (list_position(hs, list_min(hs)) - 1)::INTEGER END)::BIGINT AS heads, count(*) AS n FROM b GROUP BY 1"
)
def head_subbags(spark, sf_dir):
    """How many rows each set of heads has drawn."""
    return table(spark, sf_dir, "embeddings").select(subbag(F.col("vec_id")).alias("heads")).groupBy("heads").agg(F.count("*").alias("n"))
