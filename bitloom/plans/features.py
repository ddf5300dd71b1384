"""Queries on vectors: normalisation, affinity graphs, pooling, binarisation, moments for closed-form encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import encoders
from ..operators import moments, similarity
from ..operators.quantile import quantiles
from ..session import settled
from ..sources.items import items, with_split
from ..sources.tables import table
from .registry import ITEMS, query
from .retrieval import from_twelfth, rounded, sql_from_twelfth


@query("WITH n AS (SELECT vec_id, embedding, greatest(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])), 1e-8) AS len FROM embeddings) SELECT vec_id, round(len, 6) AS length, round(list_sum([(x::DOUBLE / len) ** 2 FOR x IN embedding]), 6) AS unit FROM n")
def normalized_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", C.norm(F.col("embedding")).alias("length"), C.normalized(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.round("length", 6).alias("length"), F.round(C.dot(F.col("u"), F.col("u")), 6).alias("unit"))


@query("WITH x AS (SELECT unnest(range(0, 64)) AS dim, embedding FROM embeddings) SELECT dim::INTEGER AS dim, round(quantile_cont(embedding[dim + 1]::DOUBLE, 0.5), 8) AS median FROM x GROUP BY dim")
def dimension_medians(spark, sf_dir):
    return rounded(quantiles(table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("dim", "x")), ["dim"], "x", {"median": 0.5}))


@query("WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS dim, embedding FROM embeddings), m AS (SELECT dim, quantile_cont(embedding[dim + 1]::DOUBLE, 0.5) AS med FROM x GROUP BY dim) SELECT vec_id, sum((embedding[dim + 1]::DOUBLE >= med)::INTEGER)::BIGINT AS ones FROM x JOIN m USING (dim) GROUP BY vec_id")
def median_codes(spark, sf_dir):
    """Bits by each dimension's median: the medians are one row of as many numbers as dimensions."""
    e = table(spark, sf_dir, "embeddings")
    med = quantiles(e.select(F.posexplode("embedding").alias("dim", "x")), ["dim"], "x", {"m": 0.5})
    row = med.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda z: z["m"]).alias("med"))
    bits = F.zip_with("embedding", "med", lambda x, m: (x.cast("double") >= m).cast("long"))
    return e.crossJoin(F.broadcast(row)).select("vec_id", F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b).alias("ones"))


@query("WITH x AS (SELECT unnest(range(0, 64)) AS i, embedding FROM embeddings), y AS (SELECT i, unnest(range(0, 64)) AS j, embedding FROM x) SELECT i::INTEGER AS i, j::INTEGER AS j, round(sum(embedding[i + 1]::DOUBLE * embedding[j + 1]::DOUBLE), 4) AS gram FROM y GROUP BY ALL")
def gram_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("embedding")
    each = e.select("embedding", F.posexplode("embedding").alias("i", "x")).select("i", "x", F.posexplode("embedding").alias("j", "y"))
    return each.groupBy("i", "j").agg(F.round(F.sum(F.col("x").cast("double") * F.col("y").cast("double")), 4).alias("gram"))


def _sums(spark, sf_dir):
    """Of vectors x and label indicators: n, sums of x, of x x', and of x by label, as arrays; dimensions squared, whatever the rows."""
    import numpy as np

    e = table(spark, sf_dir, "embeddings").select("embedding", "label")
    m = moments.bank_moments(e, F.transform("embedding", lambda x: x.cast("double"))).first()
    if m is None:
        return 0, np.zeros(0), np.zeros((0, 0)), {}, {}
    by = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n")).collect()
    of, counts = {}, {}
    for r in by:
        of.setdefault(r.label, np.zeros(len(m.bit_sum)))[r.i] = r.s
        counts[r.label] = r.n
    return m.n, np.array(m.bit_sum), np.array(m.gram), of, counts


def axes_of(n, total, gram, k):
    """(variance, axis) of the k greatest principal axes, each with its greatest component positive; a solve as wide as the vectors."""
    import numpy as np

    mean = total / max(n, 1)
    values, vectors = np.linalg.eigh(gram / max(n, 1) - np.outer(mean, mean)) if n else (np.zeros(0), np.zeros((0, 0)))
    out = []
    for at in np.argsort(-values)[:k]:
        v = vectors[:, at]
        out.append((float(values[at]), v * np.sign(v[np.argmax(np.abs(v))])))
    return out


def ridge_of(n, total, gram, of, counts, penalty):
    """(weights, intercepts) for the labels in order: least squares to 0 and 1 with a penalty on the weights alone, by centred normal equations."""
    import numpy as np

    names = sorted(of)
    mean = total / n
    share = np.array([counts[x] / n for x in names])
    rhs = np.stack([of[x] for x in names], 1) - np.outer(total, share)
    w = np.linalg.solve(gram - n * np.outer(mean, mean) + penalty * np.eye(len(mean)), rhs)
    return names, w, share - mean @ w


@query()
def principal_axes(spark, sf_dir, k=8):
    """The k greatest principal axes: sums of products by Spark, the solve on the driver."""
    n, total, gram, _, _ = _sums(spark, sf_dir)
    out = [(axis, i, value, float(x)) for axis, (value, v) in enumerate(axes_of(n, total, gram, k)) for i, x in enumerate(v)]
    return spark.createDataFrame(out, "axis int, dim int, variance double, weight double")


@query()
def ridge_labels(spark, sf_dir, penalty=1.0):
    """Each row's label by ridge regression to label indicators, against its own: sums are distributed, the solve is as wide as the vectors."""
    e = table(spark, sf_dir, "embeddings").select("embedding", "label")
    n, total, gram, of, counts = _sums(spark, sf_dir)
    if not n:
        return e.select("label", F.col("label").alias("predicted"), F.lit(0).cast("long").alias("n"))
    names, w, b = ridge_of(n, total, gram, of, counts, penalty)
    scores = F.array(*(C.dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in w[:, j]))) + float(b[j]) for j in range(len(names))))
    best = F.array_position(scores, F.array_max(scores)) - 1
    return e.select("label", F.get(F.array(*map(F.lit, names)), best.cast("int")).alias("predicted")).groupBy("label", "predicted").agg(F.count("*").alias("n"))


_SIM = f"WITH {ITEMS}, u AS (SELECT id, [x::DOUBLE / greatest(sqrt(list_sum([y::DOUBLE * y::DOUBLE FOR y IN image])), 1e-8) FOR x IN image] AS v, is_q, is_d FROM split), s AS (SELECT q.id AS qid, d.id AS did, round(list_dot_product(q.v, d.v), 9) AS sim FROM u q, u d WHERE q.is_q AND d.is_d)"


def _images(spark, sf_dir):
    """(id, v) of queries and of the gallery."""
    s = with_split(items(spark, sf_dir))
    return tuple(s.where(on).select("id", F.col("image").alias("v")) for on in ("is_q", "is_d"))


@query(_SIM + ", k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, did) AS k FROM s) SELECT qid, did, k, round(sim, 6) AS sim FROM k WHERE k IN (3, 4)")
def near_affinities(spark, sf_dir):
    """The third and fourth nearest gallery rows of each query."""
    s = similarity.nearest(*_images(spark, sf_dir), 32, 4)
    return s.where("k >= 3").select("qid", "did", "k", F.round("sim", 6).alias("sim"))


@query(_SIM + ", k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim, did) AS low FROM s), p AS (SELECT qid, did, CASE WHEN low <= 5 THEN 0 ELSE 2 / (1 + exp(-sim)) - 1 END AS a FROM k) SELECT qid, round(sum(a), 6) AS degree, sum((a = 0)::INTEGER)::BIGINT AS pruned, round(max(a), 6) AS strongest FROM p GROUP BY qid")
def pruned_affinity(spark, sf_dir):
    """Affinities 2 / (1 + exp(-s)) - 1 with each query's five least set to 0."""
    p = similarity.pruned(*_images(spark, sf_dir), 32, 5)
    return p.select("qid", F.round("degree", 6).alias("degree"), "pruned", F.round("strongest", 6).alias("strongest"))


@query(_SIM + ", a AS (SELECT x.qid AS a, y.qid AS b, sum(x.sim * y.sim) / (sqrt(sum(x.sim ** 2)) * sqrt(sum(y.sim ** 2))) AS second FROM s x JOIN s y ON x.did = y.did AND x.qid < y.qid GROUP BY ALL) SELECT a, b, round(second, 6) AS second_order FROM a")
def second_order_affinity(spark, sf_dir):
    """Cosines of queries' rows of similarities: for unit rows of vectors that is a product with the gallery's Gram matrix."""
    q, d = _images(spark, sf_dir)
    both = settled(similarity.through(q, similarity.gram_of(d, 32)))  # as long as queries and read four times
    a, b = both.select("id", F.col("y").alias("v"), "n"), both.select("id", F.col("x").alias("v"), "n")
    return similarity.upper(a, b, 32, 6).withColumnsRenamed({"qid": "a", "did": "b", "cosine": "second_order"})


@query("WITH s AS (SELECT unnest(range(1, 33)) AS shift, vec_id, label, embedding FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings) SELECT a.shift::INTEGER AS shift, count(*) AS n_pairs, round(avg((a.label = b.label)::INTEGER), 8) AS same, round(avg(list_dot_product(a.embedding[1:32]::DOUBLE[], b.embedding[33:64]::DOUBLE[])), 6) AS mean_dot FROM s a, n JOIN embeddings b ON b.vec_id = (a.vec_id + a.shift) % n.n GROUP BY a.shift")
def rolled_pairs(spark, sf_dir):
    """Mismatched pairs: each image half with the text half of the row 1 to 32 places on."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    a = e.select(F.explode(F.sequence(F.lit(1), F.lit(32))).alias("shift"), "label", F.slice("embedding", 1, 32).alias("x"), "vec_id").withColumn("other", (F.col("vec_id") + F.col("shift")) % F.lit(max(n, 1)))
    b = e.select(F.col("vec_id").alias("other"), F.col("label").alias("l2"), F.slice("embedding", 33, 32).alias("y"))
    return a.join(b, "other").groupBy("shift").agg(F.count("*").alias("n_pairs"), F.round(F.avg((F.col("label") == F.col("l2")).cast("int")), 8).alias("same"), F.round(F.avg(C.dot(F.col("x"), F.col("y"))), 6).alias("mean_dot"))


@query(f"WITH x AS (SELECT label, unnest(range(0, 64)) AS dim, embedding FROM embeddings), m AS (SELECT label, dim, {sql_from_twelfth('avg(embedding[dim + 1]::DOUBLE)', 12)}::FLOAT AS v FROM x GROUP BY ALL) SELECT label, list([{sql_from_twelfth('v::DOUBLE', 5)}] ORDER BY dim) AS pooled FROM m GROUP BY label")
def pooled_vectors(spark, sf_dir):
    """Means by label, summed in doubles and kept, to 12 places, as floats, in order of dimension."""
    m = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(from_twelfth(F.avg(F.col("x").cast("double")), 12).cast("float").alias("v"))
    return m.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda z: F.array(from_twelfth(z["v"].cast("double"), 5))).alias("pooled"))


_TURNED = "[round(list_sum([CASE WHEN bit_count(i & j) % 2 = 0 THEN embedding[j + 1]::DOUBLE ELSE -(embedding[j + 1]::DOUBLE) END FOR j IN range(0, 64)]), 6) FOR i IN range(0, 64)]"
_HALF = lambda v, first: f"list_sum([CASE WHEN {v}[i + {first + 1}] >= 0 THEN 1::BIGINT << i ELSE 0 END FOR i IN range(0, 32)])::BIGINT"


@query(
    f"WITH t AS (SELECT vec_id, embedding AS v, 'signs' AS encoder FROM embeddings UNION ALL SELECT vec_id, {_TURNED} AS v, 'hadamard' AS encoder FROM embeddings) "
    f"SELECT vec_id, encoder, {_HALF('v', 0)} AS lo, {_HALF('v', 32)} AS hi FROM t"
)
def encode_distinct(spark, sf_dir):
    """The codes that two registered encoders, one a column function and one over batches, give all 64 numbers; equal vectors once."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    low = F.lit(0xFFFFFFFF).cast("long")
    each = [encoders.encode_distinct(e, "embedding", n).select("vec_id", F.lit(n).alias("encoder"), encoders.packed(F.col("code")).alias("c")) for n in ("signs", "hadamard")]
    return each[0].unionAll(each[1]).select("vec_id", "encoder", F.col("c").bitwiseAND(low).alias("lo"), F.shiftrightunsigned("c", 32).alias("hi"))
