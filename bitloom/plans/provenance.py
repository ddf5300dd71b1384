"""Queries on texts, locators, identities and checks."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import sha, unsigned_64
from ..functions.labels import multi_hot
from ..operators import provenance, text
from ..sources import readers
from ..sources.tables import table
from ..streaming.chunks import shared_folder
from .registry import query

#: Bytes of text to a file that `numbered_lines` writes, about.
FILE_BYTES = 64 << 20


@query("SELECT doc_id, sha256(nfc_normalize(regexp_replace(text, '\\r\\n?', chr(10), 'g'))) AS digest, contains(text, chr(0)) AS has_nul FROM documents")
def normalized_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(text.nfc(text.unix_lines(F.col("text"))).cast("binary"), 256).alias("digest"), F.instr("text", chr(0)).cast("boolean").alias("has_nul"))


@query("SELECT doc_id, string_split(text, chr(10))[1] AS first_line, len(string_split(text, chr(10))) AS n_lines, string_split(text, chr(10))[3] AS third_line FROM documents")
def line_locators(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.line(F.col("text"), 0).alias("first_line"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), text.line(F.col("text"), 2).alias("third_line"))


@query("SELECT item_id, upper(hex(encode(text))[1:80]) AS head, octet_length(encode(text)) AS n_bytes, TRY(decode(unhex(hex(encode(text))[1:80]))) AS head_text FROM benchmark")
def byte_locators(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    head = text.byte_range(F.col("text"), 0, 40)
    return b.select("item_id", F.hex(head).alias("head"), F.octet_length("text").cast("long").alias("n_bytes"), text.decoded(head).alias("head_text"))


@query("SELECT event_id, json_extract_string(props, '/k') AS k, event_type FROM events")
def json_pointers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.json_pointer(F.col("props"), "/k").alias("k"), "event_type")


@query("SELECT conv_id, count(*) AS turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, count(*) FILTER (role = 'user') AS asked, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def grouped_captions(spark, sf_dir):
    """Texts grouped by their item, in sums that tasks make first: no item's texts are gathered."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text")).alias("chars"))


@query("SELECT p_type, list_sort(list(DISTINCT 'a photo of ' || lower(p_name))) [1:3] AS prompts, count(DISTINCT p_name) AS n FROM part GROUP BY p_type")
def prompts(spark, sf_dir):
    """The three least prompts of each type, and how many names it has: names are made distinct first, and only three of a type meet."""
    p = table(spark, sf_dir, "part").select("p_type", F.concat(F.lit("a photo of "), F.lower("p_name")).alias("prompt"), "p_name")
    place = F.row_number().over(Window.partitionBy("p_type").orderBy("prompt"))
    least = p.select("p_type", "prompt").distinct().withColumn("place", place).where("place <= 3").groupBy("p_type").agg(F.sort_array(F.collect_list("prompt")).alias("prompts"))
    n = p.select("p_type", "p_name").distinct().groupBy("p_type").agg(F.count("p_name").alias("n"))
    return least.join(n, "p_type").select("p_type", "prompts", "n")


@query("SELECT page_id, regexp_extract(url, '([^/?#]*)/?([?#].*)?$', 1) AS base, regexp_extract(url, '([0-9]+)', 1) AS photo_id, regexp_replace(url, '[0-9]+', '#', 'g') AS scrubbed FROM pages")
def url_stems(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "([^/?#]*)/?([?#].*)?$", 1).alias("base"), F.regexp_extract("url", "([0-9]+)", 1).alias("photo_id"), F.regexp_replace("url", "[0-9]+", "#").alias("scrubbed"))


@query("SELECT doc_id, sha256(concat_ws(chr(0), 'row-v1', 'documents', doc_id::VARCHAR)) AS row_id, ('0x' || sha256(concat_ws(chr(0), 'u64', doc_id::VARCHAR))[1:16])::UBIGINT::DECIMAL(20, 0) AS identity FROM documents")
def row_identities(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sha("row-v1", "documents", F.col("doc_id")).alias("row_id"), unsigned_64(sha("u64", F.col("doc_id"))).alias("identity"))


@query("WITH i AS (SELECT sha256(concat_ws(chr(0), 'u64', doc_id::VARCHAR))[1:16] AS h, sha256(concat_ws(chr(0), 'row-v1', 'documents', doc_id::VARCHAR)) AS r FROM documents) SELECT count(*) AS n, count(DISTINCT h) AS identities, count(DISTINCT r) AS row_ids, sum((NOT regexp_full_match(r, '[0-9a-f]{64}'))::INTEGER)::BIGINT AS malformed FROM i")
def identity_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(sha("row-v1", "documents", F.col("doc_id")).alias("r"), F.substring(sha("u64", F.col("doc_id")), 1, 16).alias("h"))
    return d.agg(F.count("*").alias("n"), F.countDistinct("h").alias("identities"), F.countDistinct("r").alias("row_ids"), F.count_if(~F.col("r").rlike("^[0-9a-f]{64}$")).alias("malformed"))


@query(
    "WITH RECURSIVE r AS (SELECT conv_id, turn // 64 AS chunk, row_number() OVER (PARTITION BY conv_id, turn // 64 ORDER BY turn) AS k, sha256(concat_ws(chr(0), 'receipt', conv_id::VARCHAR, turn::VARCHAR, role)) AS receipt FROM conversations), "
    "c AS (SELECT conv_id, chunk, 0::BIGINT AS k, repeat('0', 64) AS last FROM (SELECT DISTINCT conv_id, chunk FROM r) UNION ALL SELECT r.conv_id, r.chunk, r.k, sha256(c.last || r.receipt) FROM c JOIN r ON r.conv_id = c.conv_id AND r.chunk = c.chunk AND r.k = c.k + 1), "
    "h AS (SELECT conv_id, chunk, max(k) AS n, arg_max(last, k) AS last FROM c GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY chunk) AS j FROM h), "
    "d AS (SELECT conv_id, 0::BIGINT AS j, 0::BIGINT AS n, repeat('0', 64) AS last FROM (SELECT DISTINCT conv_id FROM o) UNION ALL SELECT o.conv_id, o.j, (d.n + o.n)::BIGINT, sha256(d.last || o.last) FROM d JOIN o ON o.conv_id = d.conv_id AND o.j = d.j + 1) SELECT conv_id, max(j) AS chunks, arg_max(n, j) AS n, arg_max(last, j) AS last FROM d GROUP BY conv_id"
)
def receipt_chains(spark, sf_dir):
    """A hash chain over each conversation: one over each chunk of 64 turns, and one over the chunks' last hashes."""
    c = table(spark, sf_dir, "conversations").withColumn("chunk", F.expr("turn div 64"))
    heads = provenance.chains(c, ["conv_id", "chunk"], "turn", sha("receipt", F.col("conv_id"), F.col("turn"), F.col("role")))
    return provenance.chains(heads, ["conv_id"], "chunk", F.col("last"), "n").select("conv_id", F.col("n").alias("chunks"), F.col("total").alias("n"), "last")


@query("SELECT conv_id, count(*) AS turns, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS missing, count(*) - count(DISTINCT turn) AS repeated FROM conversations GROUP BY conv_id")
def frontier_contiguity(spark, sf_dir):
    """Holes and repeats in each conversation's numbers, by counts."""
    n = F.countDistinct("turn")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), (F.max("turn") - F.min("turn") + 1 - n).alias("missing"), (F.count("*") - n).alias("repeated"))


@query(
    "WITH RECURSIVE leaf AS (SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS i, sha256(concat_ws(chr(0), 'leaf', p_partkey::VARCHAR, p_name)) AS h FROM part), "
    "up AS (SELECT 0 AS level, i, h, (SELECT count(*) FROM leaf) AS n FROM leaf UNION ALL SELECT level + 1, i // 2, sha256(min_by(h, i) || max_by(h, i)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY level, i // 2, n) SELECT h AS root FROM up WHERE n = 1"
)
def merkle_root(spark, sf_dir):
    """One root over all part rows' hashes, by number."""
    p = table(spark, sf_dir, "part")
    first = p.agg(F.min("p_partkey")).first()[0] or 0
    return provenance.merkle_levels(p.select((F.col("p_partkey") - first).alias("i"), sha("leaf", F.col("p_partkey"), F.col("p_name")).alias("h")))


@query("SELECT o.o_orderkey, max(o.o_totalprice) AS price, count(*) AS n_lines FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL")
def semi_joined_manifest(spark, sf_dir):
    """A scan narrowed by a set of ids, then met by its lines."""
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders")
    o = o.join(wanted, o.o_custkey == wanted.c_custkey, "left_semi").select("o_orderkey", "o_totalprice")
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    return o.join(n, o.o_orderkey == n.l_orderkey).select("o_orderkey", F.col("o_totalprice").alias("price"), "n_lines")


@query("SELECT d.doc_id, coalesce(nullif(lower(replace(trim(d.lang), ' ', '')), ''), 'und') AS name, (l.doc_id IS NOT NULL) AS labelled, coalesce(l.toxic, 0) + 2 * coalesce(l.quality, 0) AS mask FROM documents d LEFT JOIN labels l USING (doc_id)")
def adapted_rows(spark, sf_dir):
    """A source's rows with its names in one form, and labels where there are any."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality", F.lit(True).alias("has"))
    name = F.coalesce(F.nullif(F.lower(F.replace(F.trim("lang"), F.lit(" "), F.lit(""))), F.lit("")), F.lit("und"))
    return d.join(lab, "doc_id", "left").select("doc_id", name.alias("name"), F.coalesce("has", F.lit(False)).alias("labelled"), (F.coalesce("toxic", F.lit(0)) + 2 * F.coalesce("quality", F.lit(0))).alias("mask"))


@query("SELECT vec_id, [(i = label OR i = vec_id % 10)::INTEGER FOR i IN range(0, 10)] AS hot FROM embeddings")
def multi_hot_labels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", multi_hot(F.array(F.col("label"), (F.col("vec_id") % 10).cast("int")), 10).alias("hot"))


@query("SELECT 'embeddings' AS shard, count(*) AS n, min(len(embedding)) AS narrow, max(len(embedding)) AS wide, sum((vec_id IS NULL OR embedding IS NULL)::INTEGER)::BIGINT AS nulls, sum((list_sum([(x IS NULL OR isnan(x) OR isinf(x))::INTEGER FOR x IN embedding]) > 0)::INTEGER)::BIGINT AS not_finite, count(*) - count(DISTINCT vec_id) AS repeated FROM embeddings")
def vector_shard_checks(spark, sf_dir):
    """What a sealed shard of vectors must show: rectangular, finite, without nulls or repeated ids."""
    e = table(spark, sf_dir, "embeddings")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return e.agg(F.lit("embeddings").alias("shard"), F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("narrow"), F.max(F.size("embedding")).cast("long").alias("wide"), F.count_if(F.col("vec_id").isNull() | F.col("embedding").isNull()).alias("nulls"), F.count_if(bad).alias("not_finite"), (F.count("*") - F.countDistinct("vec_id")).alias("repeated"))


@query("WITH runs AS (SELECT source, doc_id // 1024 AS run, count(*) AS n, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL), spans AS (SELECT source, run // 1024 AS span, sum(n) AS n, sha256(string_agg(h, '' ORDER BY run)) AS h FROM runs GROUP BY ALL) SELECT source, sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY span)) AS digest FROM spans GROUP BY source")
def directory_digests(spark, sf_dir):
    """A digest of each source's texts in order, over digests of runs of 1,024 ids, so that no task holds a source."""
    now = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("k"), F.lit(1).cast("long").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    for last in (False, False, True):
        by = ["source"] if last else ["source", F.expr("k div 1024").alias("up")]
        g = now.groupBy(*by).agg(F.sum("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]).alias("all"))
        h = F.sha2(F.concat_ws("", "all").cast("binary"), 256)
        now = g.select("source", "n", h.alias("digest")) if last else g.select("source", F.col("up").alias("k"), "n", h.alias("h"))
    return now


@query("SELECT event_type, to_json({'n': count(*), 'type': event_type, 'users': count(DISTINCT user_id)})::VARCHAR AS canonical FROM events GROUP BY event_type")
def canonical_json(spark, sf_dir):
    """Records as JSON with keys in order."""
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return g.select("event_type", F.to_json(F.struct("n", F.col("event_type").alias("type"), "users")).alias("canonical"))


@query("SELECT event_id, sha256('{\"at\":{\"id\":' || event_id || ',\"props\":' || json(props) || '},\"type\":\"' || event_type || '\"}') AS digest, true AS same FROM events")
def canonical_records(spark, sf_dir):
    """A digest of each event as a nested record, which two orders of its keys and other spaces don't change."""
    quote = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    one = F.concat(F.lit('{"type":'), quote("event_type"), F.lit(', "at": {"props": '), F.col("props"), F.lit(', "id": '), F.col("event_id"), F.lit("}}"))
    other = F.concat(F.lit('{"at":{"id":'), F.col("event_id"), F.lit(',"props":'), F.col("props"), F.lit('},"type":'), quote("event_type"), F.lit("}"))
    e = table(spark, sf_dir, "events").select("event_id", *(F.sha2(text.canonical(c).cast("binary"), 256).alias(n) for c, n in ((one, "digest"), (other, "again"))))
    return e.select("event_id", "digest", (F.col("digest") == F.col("again")).alias("same"))


@query(
    "WITH t AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM documents), n AS (SELECT *, coalesce(sum(len(ls)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t), "
    "l AS (SELECT before + i - 1 AS k, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM n)) SELECT length(line) AS width, count(*) AS n, sum(k)::BIGINT AS places, min(k)::BIGINT AS first FROM l GROUP BY ALL"
)
def numbered_lines(spark, sf_dir):
    """All documents as lines of text files, numbered through without reading a file whole: where lines of each length stand."""
    folder = shared_folder(spark)
    documents = table(spark, sf_dir, "documents")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    documents.repartitionByRange(max(3, math.ceil(size / FILE_BYTES)), "doc_id").sortWithinPartitions("doc_id").select(F.coalesce("text", F.lit("")).alias("value")).write.text(folder)
    found = readers.lines(spark, folder)
    per = found.groupBy("file").agg(F.count("*").alias("n"))  # a row a file
    before = per.select(F.col("file").alias("own"), (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    k = F.col("line_no") + F.col("before")
    return found.join(F.broadcast(before), F.col("file") == F.col("own")).groupBy(F.length("line").cast("long").alias("width")).agg(F.count("*").alias("n"), F.sum(k).alias("places"), F.min(k).alias("first"))
