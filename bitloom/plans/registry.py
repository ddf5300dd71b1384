"""Where the plans' queries and their DuckDB SQL meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with SQL that gives the same rows in DuckDB where there is some."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: SQL of the items, their split and their codes, for the oracles. 64-bit codes stay in two 32-bit halves.
ITEMS = """
items AS (SELECT vec_id AS id, label, embedding[1:32] AS image, embedding[33:64] AS text,
  sha256(concat_ws(chr(0), 'row-v1', 'embeddings', vec_id::VARCHAR)) AS row_id,
  list_sort(list_distinct([label, (vec_id % 10)::INTEGER])) AS labels FROM embeddings),
qrank AS (SELECT *, row_number() OVER (ORDER BY sha256(concat_ws(chr(0), 'split-v1', '42', 'embeddings', 'query', id::VARCHAR)), id) AS qn FROM items),
qsplit AS (SELECT * EXCLUDE qn, qn <= (SELECT count(*) // 10 FROM items) AS is_q FROM qrank),
trank AS (SELECT id, row_number() OVER (ORDER BY sha256(concat_ws(chr(0), 'split-v1', '42', 'embeddings', 'train', id::VARCHAR)), id) AS tn FROM qsplit WHERE NOT is_q),
split AS (SELECT s.*, coalesce(t.tn <= (SELECT count(*) // 4 FROM items), false) AS is_t, NOT is_q AS is_d FROM qsplit s LEFT JOIN trank t USING (id))"""
CODES = (
    ITEMS
    + """,
parts AS (SELECT *, 'image' AS modality, image AS v FROM split UNION ALL SELECT *, 'text' AS modality, text AS v FROM split),
packed AS (SELECT * EXCLUDE v,
  list_sum([CASE WHEN v[i + 1] >= 0 THEN (1::BIGINT << i) ELSE 0 END FOR i IN range(0, 16)])::BIGINT AS c16,
  list_sum([CASE WHEN v[i + 1] >= 0 THEN (1::BIGINT << i) ELSE 0 END FOR i IN range(0, 32)])::BIGINT AS c32,
  list_sum([CASE WHEN v[i + 1]::DOUBLE - v[(i + 1) % 32 + 1]::DOUBLE >= 0 THEN (1::BIGINT << i) ELSE 0 END FOR i IN range(0, 32)])::BIGINT AS s32 FROM parts),
codes AS (SELECT * EXCLUDE (c16, c32, s32, image, text), 16 AS bits, c16 AS lo, 0::BIGINT AS hi FROM packed
  UNION ALL SELECT * EXCLUDE (c16, c32, s32, image, text), 32, c32, 0::BIGINT FROM packed
  UNION ALL SELECT * EXCLUDE (c16, c32, s32, image, text), 64, c32, s32 FROM packed)"""
)
PAIRS = (
    CODES
    + """,
pairs AS (SELECT CASE WHEN q.modality = 'image' THEN 'i2t' ELSE 't2i' END AS direction, q.bits, q.id AS qid, d.id AS did, q.label AS qlabel, d.label AS dlabel,
  q.labels AS qlabels, d.labels AS dlabels, q.lo AS qlo, d.lo AS dlo, q.hi AS qhi, d.hi AS dhi,
  (bit_count(xor(q.lo, d.lo)) + bit_count(xor(q.hi, d.hi)))::INTEGER AS r
  FROM codes q JOIN codes d ON q.bits = d.bits AND q.modality <> d.modality WHERE q.is_q AND d.is_d),
graded AS (SELECT *, len(list_intersect(qlabels, dlabels)) / len(list_distinct(list_concat(qlabels, dlabels)))::DOUBLE AS gain FROM pairs),
shells AS (SELECT direction, bits, qid, r, count(*) AS n, sum((gain > 0)::INTEGER) AS m, sum(gain) AS g FROM graded GROUP BY ALL),
run AS (SELECT *, coalesce(sum(n) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st, coalesce(sum(m) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev,
  sum(n) OVER (PARTITION BY direction, bits, qid) AS total, sum(m) OVER (PARTITION BY direction, bits, qid) AS relevant
  FROM shells WINDOW b AS (PARTITION BY direction, bits, qid ORDER BY r))"""
)
SERIES = """,
series AS (SELECT k, coalesce(sum(1.0::DOUBLE / nullif(k, 0)) OVER (ORDER BY k), 0) AS h, coalesce(sum(CASE WHEN k > 0 THEN 1.0::DOUBLE / log2(k + 1) END) OVER (ORDER BY k), 0) AS dc FROM range(0, (SELECT count(*) + 1001 FROM embeddings)) t(k))"""
