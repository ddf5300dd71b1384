"""Queries on label sets, MinHash sketches and posteriors. An order's posteriors are shares of its lines by brand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.codes import hamming
from ..operators import minhash, rank
from ..sources.items import items, with_split
from ..sources.tables import table
from .registry import ITEMS, query
from .retrieval import from_twelfth, rounded, sql_from_twelfth

_SKETCH = ITEMS + (
    ", cm AS (SELECT bit, label, sha256(concat_ws(chr(0), 'minhash', '20260822', bit::VARCHAR, label::VARCHAR)) AS ord FROM (SELECT DISTINCT unnest(labels) AS label FROM items), range(0, 16) b(bit)), "
    "one AS (SELECT id, bit, min_by(('0x' || ord[64])::INTEGER % 2, ord) AS colour FROM (SELECT id, unnest(labels) AS label FROM split) JOIN cm USING (label) GROUP BY ALL), sk AS (SELECT id, sum(colour * (1::BIGINT << bit))::BIGINT AS sketch FROM one GROUP BY id)"
)


def _sketches(spark, sf_dir):
    s = with_split(items(spark, sf_dir))
    return s, minhash.encode(s, "labels", "id", minhash.colour_map(s.select(F.explode("labels").alias("label")), 16))


@query(f"WITH {_SKETCH} SELECT id, sketch FROM sk")
def minhash_sketches(spark, sf_dir):
    return _sketches(spark, sf_dir)[1]


@query(f"WITH {_SKETCH}, p AS (SELECT len(list_intersect(q.labels, d.labels)) / len(list_distinct(list_concat(q.labels, d.labels)))::DOUBLE AS j, bit_count(xor(a.sketch, b.sketch)) AS r FROM split q JOIN sk a ON a.id = q.id, split d JOIN sk b ON b.id = d.id WHERE q.is_q AND d.is_d) SELECT round(j, 8) AS jaccard, count(*) AS n_pairs, round(avg(r), 8) AS observed, round(8 * (1 - j), 8) AS expected FROM p GROUP BY j")
def minhash_mismatch(spark, sf_dir):
    s, sk = _sketches(spark, sf_dir)
    s = s.join(sk, "id")
    q = s.where("is_q").select(F.col("labels").alias("ql"), F.col("sketch").alias("qs"), F.col("id").alias("qid"))
    d = s.where("is_d").groupBy(F.col("labels").alias("dl"), F.col("sketch").alias("ds")).agg(F.count("*").alias("c"))
    p = rank.against_all(q, d).withColumns({"j": L.jaccard(F.col("ql"), F.col("dl")), "r": hamming(F.col("qs"), F.col("ds"))})
    out = p.groupBy("j").agg(F.sum("c").alias("n_pairs"), (F.sum(F.col("r") * F.col("c")) / F.sum("c")).alias("observed"))
    return rounded(out.select(F.col("j").alias("jaccard"), "n_pairs", "observed", minhash.expected_mismatch(F.col("j"), 16).alias("expected")))


@query(f"WITH {ITEMS} SELECT label, count(*) AS n, round(least(greatest(((SELECT count(*) FROM split WHERE is_t) - count(*)) / count(*), 1), 20), 8) AS weight, round(1 / sqrt(count(*) / (SELECT count(*) FROM split WHERE is_t)), 8) AS target FROM split WHERE is_t GROUP BY label")
def class_weights(spark, sf_dir):
    """Positive-class weights clip((n - p) / p, 1, 20) and inverse square roots of prevalence, over training rows."""
    t = with_split(items(spark, sf_dir)).where("is_t")
    per = t.groupBy("label").agg(F.count("*").alias("n"))
    per = per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("all"))))
    return rounded(per.select("label", "n", F.least(F.greatest((F.col("all") - F.col("n")) / F.col("n"), F.lit(1.0)), F.lit(20.0)).alias("weight"), (1 / F.sqrt(F.col("n") / F.col("all"))).alias("target")))


_POST = """WITH b AS (SELECT l_orderkey AS o, (substr(p_brand, 7))::INTEGER AS brand, l_quantity AS quantity, l_extendedprice AS price FROM lineitem JOIN part ON l_partkey = p_partkey),
names AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS k FROM (SELECT DISTINCT brand FROM b)),
c AS (SELECT o, k, sum(quantity) AS quantity, sum(price) AS price, count(*)::DOUBLE AS n, max(quantity) AS most FROM b JOIN names USING (brand) GROUP BY ALL),
s AS (SELECT o, k, most, quantity / sum(quantity) OVER (PARTITION BY o) AS h1, price / sum(price) OVER (PARTITION BY o) AS h2, n / sum(n) OVER (PARTITION BY o) AS h3 FROM c)"""


def _lines(spark, sf_dir):
    """Lines with the brand of their part."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("brand"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    return lines.join(part, lines.l_partkey == part.p_partkey)


def _used(spark, sf_dir):
    """The brands in use, numbered: a few dozen rows."""
    return _lines(spark, sf_dir).select("brand").distinct().withColumn("k", F.row_number().over(Window.orderBy("brand")) - 1)


def _shares(spark, sf_dir):
    """(o, brand, most, h1, h2, h3): an order's share in a brand by quantity, price and lines, and its largest quantity there."""
    b = _lines(spark, sf_dir).where("brand is not null")
    c = b.groupBy(F.col("l_orderkey").alias("o"), "brand").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.count("*").cast("double").alias("n"), F.max("l_quantity").alias("most"))
    w = Window.partitionBy("o")
    return c.select("o", "brand", "most", *((F.col(x) / F.sum(x).over(w)).alias(h) for h, x in (("h1", "quantity"), ("h2", "price"), ("h3", "n"))))


@query(
    _POST + ", t AS (SELECT t / 10.0::DOUBLE AS threshold FROM range(1, 7) r(t)), o AS (SELECT o, threshold, max(round(h1, 9)) AS top FROM s, t GROUP BY ALL), f AS (SELECT s.o, threshold, min(k) AS first FROM s JOIN o ON s.o = o.o AND round(h1, 9) = top GROUP BY ALL), "
    "a AS (SELECT s.o, o.threshold, k, most >= 25 AS truth, CASE WHEN top >= o.threshold THEN round(h1, 9) >= o.threshold ELSE k = first END AS act FROM s JOIN o ON s.o = o.o JOIN f ON f.o = o.o AND f.threshold = o.threshold), "
    "j AS (SELECT o, threshold, sum((truth AND act)::INTEGER) / greatest(sum((truth OR act)::INTEGER), 1)::DOUBLE AS j FROM a GROUP BY ALL), m AS (SELECT threshold, round(avg(j), 8) AS mean_jaccard FROM j GROUP BY ALL) SELECT threshold, mean_jaccard, threshold = first_value(threshold) OVER (ORDER BY mean_jaccard DESC, threshold DESC) AS chosen FROM m"
)
def threshold_calibration(spark, sf_dir):
    """Thresholds on posteriors by the mean Jaccard of active and true sets (a label is true by one line of 25 or more); ties: the larger."""
    s = _shares(spark, sf_dir).withColumn("h1", F.round("h1", 9))
    o = s.groupBy("o").agg(F.sort_array(F.collect_list(F.struct("brand", "h1", "most"))).alias("v"))
    o = o.select("o", F.transform("v", lambda x: x["h1"]).alias("p"), F.filter(F.transform("v", lambda x, i: F.when(x["most"] >= 25, i).otherwise(-1)), lambda i: i >= 0).alias("truth"))
    o = o.select("*", F.explode(F.array(*(F.lit(t / 10.0) for t in range(1, 7)))).alias("threshold"))
    act = L.active(F.col("p"), F.col("threshold"))
    j = F.size(F.array_intersect(act, "truth")) / F.greatest(F.size(F.array_union(act, "truth")), F.lit(1))
    m = o.groupBy("threshold").agg(F.round(F.avg(j), 8).alias("mean_jaccard"))
    best = m.agg(F.max(F.struct("mean_jaccard", "threshold")).alias("b")).select(F.col("b.threshold").alias("best"))
    return m.crossJoin(F.broadcast(best)).select("threshold", "mean_jaccard", (F.col("threshold") == F.col("best")).alias("chosen"))


@query(
    _POST + ", p AS (SELECT a.o, coalesce(sum(ln(1 - least(a.h1 * b.h1, 1 - 1e-7))), 0) AS l1, sum(a.h1 * b.h1) AS i1, sum(a.h1 + b.h1 - a.h1 * b.h1) AS u1 FROM (SELECT g.o, n.k, coalesce(s.h1, 0) AS h1 FROM (SELECT DISTINCT o FROM s) g CROSS JOIN names n LEFT JOIN s ON s.o = g.o AND s.k = n.k) a JOIN (SELECT g.o, n.k, coalesce(s.h1, 0) AS h1 FROM (SELECT DISTINCT o FROM s) g CROSS JOIN names n LEFT JOIN s ON s.o = g.o AND s.k = n.k) b ON b.o = a.o + 1 AND a.k = b.k GROUP BY a.o) SELECT o, round(1 - exp(l1), 8) AS relevance, round(i1 / greatest(u1, 1e-8), 8) AS soft_jaccard FROM p"
)
def soft_relevance(spark, sf_dir):
    """Noisy-or relevance and soft Jaccard of each order with the next one."""
    s = _shares(spark, sf_dir)
    o = s.groupBy("o").agg(F.sort_array(F.collect_list(F.struct("brand", "h1"))).alias("m"))
    # brands that neither order has add nothing, so that no posterior is filled up
    b = o.select((F.col("o") - 1).alias("o"), F.col("m").alias("next"))
    both = o.join(b, "o").withColumn("brands", F.array_sort(F.array_union("m.brand", "next.brand")))
    share = lambda of: F.transform("brands", lambda x: F.coalesce(F.get(F.filter(of, lambda z: z["brand"] == x), F.lit(0))["h1"], F.lit(0.0)))
    both = both.select("o", share("m").alias("p"), share("next").alias("q"))
    return rounded(both.select("o", L.soft_relevance(F.col("p"), F.col("q")).alias("relevance"), L.soft_jaccard(F.col("p"), F.col("q")).alias("soft_jaccard")))


@query(_POST + " SELECT count(*) AS cells, round(avg(abs(h1 - h2)), 8) AS mad_12, round(avg(abs(h1 - h3)), 8) AS mad_13, round(avg(abs(h2 - h3)), 8) AS mad_23, round(avg(sqrt(((h1 - (h1 + h2 + h3) / 3) ** 2 + (h2 - (h1 + h2 + h3) / 3) ** 2 + (h3 - (h1 + h2 + h3) / 3) ** 2) / 3)), 8) AS mean_std, avg(abs(h1 - h2)) > 0.01 AND avg(abs(h1 - h3)) > 0.01 AS diverse FROM s")
def head_diversity(spark, sf_dir):
    h = [F.col(f"h{i}") for i in (1, 2, 3)]
    mean = (h[0] + h[1] + h[2]) / 3
    std = F.sqrt(sum((x - mean) * (x - mean) for x in h) / 3)
    mad = lambda a, b: F.avg(F.abs(a - b))
    out = _shares(spark, sf_dir).agg(F.count("*").alias("cells"), mad(h[0], h[1]).alias("mad_12"), mad(h[0], h[2]).alias("mad_13"), mad(h[1], h[2]).alias("mad_23"), F.avg(std).alias("mean_std"))
    return rounded(out.withColumn("diverse", (F.col("mad_12") > 0.01) & (F.col("mad_13") > 0.01)))


@query(_POST + f" SELECT o, k::INTEGER AS k, {sql_from_twelfth('(h1 + h2 + h3) / 3')} AS mean, {sql_from_twelfth('least(h1, h2, h3)')} AS low, {sql_from_twelfth('greatest(h1, h2, h3)')} AS high, list_sort([{', '.join(sql_from_twelfth(f'h{i}') for i in (1, 2, 3))}]) AS evidence FROM s")
def head_summary(spark, sf_dir):
    """Mean, least and greatest over heads, and the heads in an order that does not depend on theirs; to 8 places, from 12."""
    h = F.array("h1", "h2", "h3")
    mean = F.aggregate(h, F.lit(0.0), lambda a, x: a + x) / 3
    s = _shares(spark, sf_dir).join(F.broadcast(_used(spark, sf_dir)), "brand")
    return s.select("o", "k", from_twelfth(mean).alias("mean"), from_twelfth(F.array_min(h)).alias("low"), from_twelfth(F.array_max(h)).alias("high"), F.array_sort(F.transform(h, lambda x: from_twelfth(x))).alias("evidence"))


_EACH = lambda form: ", ".join(form.format(i=i) for i in (1, 2, 3))


@query(
    _POST + f", t AS (SELECT o, {_EACH('sum(h{i}) AS s{i}')} FROM s GROUP BY o), j AS (SELECT a.o, {_EACH('sum(ln(1 - least(a.h{i} * b.h{i}, 1 - 1e-7))) AS l{i}, sum(a.h{i} * b.h{i}) AS b{i}')} FROM s a JOIN s b ON b.o = a.o + 1 AND a.k = b.k GROUP BY a.o) "
    f"SELECT a.o, flatten(list_sort([{_EACH('[' + sql_from_twelfth('1 - exp(coalesce(l{i}, 0))') + ', ' + sql_from_twelfth('coalesce(b{i}, 0) / greatest(a.s{i} + b.s{i} - coalesce(b{i}, 0), 1e-8)') + ']')}])) AS evidence FROM t a JOIN t b ON b.o = a.o + 1 LEFT JOIN j ON j.o = a.o"
)
def relation_evidence(spark, sf_dir):
    """Each head's (relevance, soft Jaccard) of an order and the next one, the pairs in an order that does not depend on the heads'; to 8 places, from 12.

    Labels that only one of both has add nothing to a product, so rows meet by label and no posterior is filled up.
    """
    s = _shares(spark, sf_dir)
    heads = ("h1", "h2", "h3")
    after = s.select((F.col("o") - 1).alias("o"), "brand", *(F.col(h).alias(f"next_{h}") for h in heads))
    both = lambda h: F.col(h) * F.col(f"next_{h}")
    logs = (F.sum(F.log1p(-F.least(both(h), F.lit(1 - 1e-7)))).alias(f"log_{h}") for h in heads)
    met = s.join(after, ["o", "brand"]).groupBy("o").agg(*logs, *(F.sum(both(h)).alias(f"both_{h}") for h in heads))
    whole = s.groupBy("o").agg(*(F.sum(h).alias(f"a_{h}") for h in heads))
    other = whole.select((F.col("o") - 1).alias("o"), *(F.col(f"a_{h}").alias(f"b_{h}") for h in heads))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    relevance = lambda h: from_twelfth(-F.expm1(zero(f"log_{h}")))
    overlap = lambda h: from_twelfth(zero(f"both_{h}") / F.greatest(F.col(f"a_{h}") + F.col(f"b_{h}") - zero(f"both_{h}"), F.lit(1e-8)))
    pairs = F.array(*(F.array(relevance(h), overlap(h)) for h in heads))
    return whole.join(other, "o").join(met, "o", "left").select("o", F.flatten(F.array_sort(pairs)).alias("evidence"))
