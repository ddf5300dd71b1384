"""Queries on areas under curves, score ranks, projected posteriors, batch graphs, code losses, hash buckets and cell names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.hashing import sha, unsigned_64
from ..operators import codebook, metrics, moments
from ..sources.tables import table
from .registry import ORACLES, query
from .retrieval import _shells, rounded
from .semantic import _POST, _shares, _used


@query(f"WITH pr AS ({ORACLES['precision_recall']}), s AS (SELECT direction, bits, grid, precision, lag(precision) OVER (PARTITION BY direction, bits ORDER BY grid) AS before FROM pr) SELECT direction, bits, round(sum((precision + before) / 2) / 100, 6) AS aupr FROM s GROUP BY ALL")
def precision_recall_area(spark, sf_dir):
    """The trapezoid area under each macro-averaged curve: 101 points a curve."""
    pr = metrics.precision_recall(_shells(spark, sf_dir))
    before = F.lag("precision").over(Window.partitionBy("direction", "bits").orderBy("grid"))
    steps = pr.select("direction", "bits", ((F.round("precision", 8) + F.round(before, 8)) / 2).alias("step"))
    return steps.groupBy("direction", "bits").agg(F.round(F.sum("step") / 100, 6).alias("aupr"))


@query("SELECT l_orderkey, l_linenumber, (dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) - 1)::BIGINT AS place FROM lineitem")
def descending_ranks(spark, sf_dir):
    """Each line's zero-based place by falling price within its order; equal prices share one."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    place = F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"))) - 1
    return x.select("l_orderkey", "l_linenumber", place.cast("long").alias("place"))


_BITS = 16


@query(
    _POST + f", g AS (SELECT k, b, CASE WHEN ('0x' || sha256(concat_ws(chr(0), 'projection-v1', b::VARCHAR, k::VARCHAR))[64])::INTEGER % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM names, range(0, {_BITS}) r(b)), "
    "m AS (SELECT b, sum(sign * total) / (SELECT count(DISTINCT o) FROM s) AS centre FROM (SELECT k, sum(h1) AS total FROM s GROUP BY k) JOIN g USING (k) GROUP BY b), "
    "p AS (SELECT o, b, sum(h1 * sign) AS x FROM s JOIN g USING (k) GROUP BY ALL) SELECT o, sum(CASE WHEN round(x - centre, 9) >= 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS code FROM p JOIN m USING (b) GROUP BY o"
)
def posterior_projections(spark, sf_dir):
    """Signs of posteriors less their mean, projected on directions of -1 and 1 that hashes of (bit, label) give."""
    s = _shares(spark, sf_dir).select("o", "brand", "h1")
    sign = lambda b: F.when(F.conv(F.substring(sha("projection-v1", str(b), F.col("k")), 64, 1), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    # hashed once a label, not once a row
    signs = _used(spark, sf_dir).select("brand", F.array(*(sign(b) for b in range(_BITS))).alias("signs"))
    each = s.join(F.broadcast(signs), "brand").select("o", *((F.col("h1") * F.col("signs")[b]).alias(f"x{b}") for b in range(_BITS)))
    own = each.groupBy("o").agg(*(F.sum(f"x{b}").alias(f"x{b}") for b in range(_BITS)))
    centre = own.agg(*(F.avg(f"x{b}").alias(f"c{b}") for b in range(_BITS)))  # one row
    bits = sum((F.when(F.round(F.col(f"x{b}") - F.col(f"c{b}"), 9) >= 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b in range(_BITS)), F.lit(0).cast("long"))
    return own.crossJoin(F.broadcast(centre)).select("o", bits.alias("code"))


_GRAPH = """WITH u AS (SELECT vec_id AS id, label, vec_id // 64 AS batch, [x::DOUBLE / greatest(sqrt(list_sum([y::DOUBLE * y::DOUBLE FOR y IN embedding[1:32]])), 1e-8) FOR x IN embedding[1:32]] AS v FROM embeddings),
s AS (SELECT a.batch, a.id AS i, b.id AS j, a.label AS li, b.label AS lj, round(list_dot_product(a.v, b.v), 9) AS sim FROM u a JOIN u b ON a.batch = b.batch),
p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY i ORDER BY sim, j) <= 8 THEN 0 ELSE 2 / (1 + exp(-sim)) - 1 END AS a FROM s),
g AS (SELECT x.i, x.j, x.li, x.lj, (x.a + y.a) / 2 AS a FROM p x JOIN p y ON x.i = y.j AND x.j = y.i)"""


@query(_GRAPH + " SELECT i, round(sum(a), 6) AS degree, sum((a = 0)::INTEGER)::BIGINT AS pruned, round(coalesce(sum(a) FILTER (li < 5 AND lj < 5), 0), 6) AS sub_degree FROM g GROUP BY i")
def batch_graph(spark, sf_dir):
    """Affinities among the rows of each batch of 64 ids, each row's 8 least set to 0, then made symmetric by the mean of both ways.

    sub_degree keeps the sub-matrix of labels below 5 alone. Batches bound the pairs: 64 a row, whatever the table.
    """
    u = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.expr("vec_id div 64").alias("batch"), C.normalized(F.slice("embedding", 1, 32)).alias("v"))
    a, b = (u.select("batch", *(F.col(c).alias(f"{c}_{n}") for c in ("id", "label", "v"))) for n in ("i", "j"))
    s = a.join(b, "batch").select("batch", "id_i", "id_j", "label_i", "label_j", F.round(C.dot(F.col("v_i"), F.col("v_j")), 9).alias("sim"))
    pruned = lambda side, other: F.row_number().over(Window.partitionBy("batch", f"id_{side}").orderBy("sim", f"id_{other}")) <= 8
    # cosines are the same both ways, so a pair's other way is its place in the other row's order
    value = 2 / (1 + F.exp(-F.col("sim"))) - 1
    s = s.withColumns({"one": F.when(pruned("i", "j"), 0.0).otherwise(value), "two": F.when(pruned("j", "i"), 0.0).otherwise(value)})
    g = s.select(F.col("id_i").alias("i"), "label_i", "label_j", ((F.col("one") + F.col("two")) / 2).alias("a"))
    sub = F.when((F.col("label_i") < 5) & (F.col("label_j") < 5), F.col("a")).otherwise(0.0)
    return g.groupBy("i").agg(F.round(F.sum("a"), 6).alias("degree"), F.count_if(F.col("a") == 0).alias("pruned"), F.round(F.sum(sub), 6).alias("sub_degree"))


@query(
    "WITH x AS (SELECT label, unnest(range(0, 32)) AS i, embedding FROM embeddings), d AS (SELECT i, avg(CASE WHEN embedding[i + 1] >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS bit, avg((abs(embedding[i + 1]::DOUBLE) - 1) ** 2) AS q, avg(ln(1 + exp(embedding[i + 1]::DOUBLE)) - (label % 2) * embedding[i + 1]::DOUBLE) AS bce FROM x GROUP BY i), "
    "y AS (SELECT i, unnest(range(0, 32)) AS j, embedding FROM x), c AS (SELECT i, j, avg(CASE WHEN (embedding[i + 1] >= 0) = (embedding[j + 1] >= 0) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS r FROM y WHERE i <> j GROUP BY ALL) "
    "SELECT round(avg(q), 6) AS quantisation, round(avg(bit * bit), 8) AS balance, (SELECT round(avg(r * r), 8) FROM c) AS correlation, round(avg(bce), 6) AS cross_entropy FROM d"
)
def code_losses(spark, sf_dir):
    """What training would minimise, as figures over all rows: distance to -1 and 1, bit balance, bit correlation, and softplus cross-entropy."""
    e = table(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 32).alias("v"))
    m = moments.bank_moments(e, C.bipolar(F.col("v")))
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n = F.col("n").cast("double")
    off = (F.aggregate(F.transform("gram", square), F.lit(0.0), lambda s, x: s + x) - 32 * n * n) / (n * n * 32 * 31)
    m = m.select((square(F.col("bit_sum")) / (32 * n * n)).alias("balance"), off.alias("correlation"))
    mean = lambda f: F.avg(F.aggregate(F.transform("v", lambda x: f(x.cast("double"))), F.lit(0.0), lambda s, x: s + x) / 32)
    own = e.agg(mean(lambda x: (F.abs(x) - 1) * (F.abs(x) - 1)).alias("quantisation"), mean(lambda x: F.log(1 + F.exp(x)) - F.pmod("label", F.lit(2)) * x).alias("cross_entropy"))
    return own.crossJoin(F.broadcast(m)).select(F.round("quantisation", 6).alias("quantisation"), F.round("balance", 8).alias("balance"), F.round("correlation", 8).alias("correlation"), F.round("cross_entropy", 6).alias("cross_entropy"))


@query("WITH b AS (SELECT source, (('0x' || sha256(concat_ws(chr(0), 'dev-v1', doc_id::VARCHAR))[1:16])::UBIGINT % 10)::INTEGER AS bucket FROM documents) SELECT source, count(*) AS n, sum((bucket < 2)::INTEGER)::BIGINT AS dev, sum((bucket >= 2)::INTEGER)::BIGINT AS rest, min(bucket) AS least FROM b GROUP BY source")
def hash_bucket_split(spark, sf_dir):
    """A development part of two hash buckets in ten, by source."""
    d = table(spark, sf_dir, "documents").select("source", (unsigned_64(sha("dev-v1", F.col("doc_id"))) % 10).cast("int").alias("bucket"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("bucket") < 2).alias("dev"), F.count_if(F.col("bucket") >= 2).alias("rest"), F.min("bucket").alias("least"))


_CELL = r"^(set[0-9]+)__([a-z]+)__([0-9]+)b__seed([0-9]+)$"


@query(
    "WITH c AS (SELECT 'set' || (o_custkey % 7) || CASE WHEN o_orderkey % 11 = 0 THEN '_' ELSE '__' END || lower(o_orderstatus) || '__' || (16 << (o_orderkey % 3)::INTEGER) || 'b__seed' || (o_orderkey % 5) AS name FROM orders), "
    f"p AS (SELECT regexp_extract(name, '{_CELL}', 1) AS dataset, regexp_extract(name, '{_CELL}', 2) AS method, TRY_CAST(regexp_extract(name, '{_CELL}', 3) AS INTEGER) AS bits, TRY_CAST(regexp_extract(name, '{_CELL}', 4) AS INTEGER) AS seed FROM c) SELECT dataset, method, bits, seed, count(*) AS n FROM p GROUP BY ALL"
)
def cell_names(spark, sf_dir):
    """Names of result cells taken apart; one of another form has empty parts."""
    o = table(spark, sf_dir, "orders")
    bar = F.when(F.col("o_orderkey") % 11 == 0, "_").otherwise("__")
    width = F.element_at(F.array(F.lit(16), F.lit(32), F.lit(64)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    name = F.concat(F.lit("set"), F.col("o_custkey") % 7, bar, F.lower("o_orderstatus"), F.lit("__"), width, F.lit("b__seed"), F.col("o_orderkey") % 5)
    part = lambda i: F.regexp_extract(F.col("name"), _CELL, i)
    number = lambda i: F.nullif(part(i), F.lit("")).cast("int")
    return o.select(name.alias("name")).select(part(1).alias("dataset"), part(2).alias("method"), number(3).alias("bits"), number(4).alias("seed")).groupBy("dataset", "method", "bits", "seed").agg(F.count("*").alias("n"))


_PROTOTYPES = codebook.prototypes(10, 32)


@query(
    f"WITH p AS (SELECT label, ([{', '.join(map(str, _PROTOTYPES))}])[label + 1]::BIGINT AS want, list_sum([CASE WHEN embedding[i + 1] >= 0 THEN 1::BIGINT << i ELSE 0 END FOR i IN range(0, 32)])::BIGINT AS code FROM embeddings WHERE label BETWEEN 0 AND 9) "
    "SELECT label, count(*) AS n, round(avg(bit_count(xor(code, want))), 8) AS distance, min(bit_count(xor(code, want)))::INTEGER AS nearest FROM p GROUP BY label"
)
def prototype_distances(spark, sf_dir):
    """How far the codes of each label are from the label's prototype."""
    want = F.element_at(F.array(*(F.lit(p).cast("long") for p in _PROTOTYPES)), F.col("label") + 1)
    e = table(spark, sf_dir, "embeddings").where("label between 0 and 9").select("label", C.hamming(C.pack(F.slice("embedding", 1, 32)), want).alias("r"))
    return rounded(e.groupBy("label").agg(F.count("*").alias("n"), F.avg("r").alias("distance"), F.min("r").alias("nearest")))
