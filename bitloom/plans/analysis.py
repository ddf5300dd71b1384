"""Queries that compare and summarise results. Cells are groups of line items: flag, status and ship mode's stand-in, the line number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.exact import exact_sums
from ..operators.quantile import quantiles
from ..sources.tables import table
from .registry import query
from .retrieval import rounded


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_returnflag")
def distribution(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    q = quantiles(x, ["l_returnflag"], "l_extendedprice", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9})
    whole = x.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
    # a group a row
    return rounded(whole.join(q, whole.l_returnflag.eqNullSafe(q.l_returnflag), "left").drop(q.l_returnflag), 4).select("l_returnflag", "mean", "p25", "median", "p75", "p90", "low", "high")


_CELLS = """WITH cells AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS line, 'net' AS metric, sum(l_extendedprice * (1 - l_discount)) AS value, sum(l_extendedprice) AS base, l_suppkey % 3 AS seed FROM lineitem GROUP BY ALL
UNION ALL SELECT l_returnflag, l_linestatus, l_linenumber, 'qty', sum(l_quantity * (1 - l_tax)), sum(l_quantity * (1 - l_discount)), l_suppkey % 3 FROM lineitem GROUP BY ALL)"""


def _cells(spark, sf_dir):
    """(flag, status, line, seed, metric, value, base): two metrics of each cell by seed, each beside what it is compared with."""
    x = table(spark, sf_dir, "lineitem")
    price, qty, disc, tax = (F.col(f"l_{c}") for c in ("extendedprice", "quantity", "discount", "tax"))
    g = x.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 3).alias("seed")).agg(
        F.sum(price * (1 - disc)).alias("v1"), F.sum(price).alias("b1"), F.sum(qty * (1 - tax)).alias("v2"), F.sum(qty * (1 - disc)).alias("b2")
    )
    both = F.explode(F.array(F.struct(F.lit("net").alias("metric"), F.col("v1").alias("value"), F.col("b1").alias("base")), F.struct(F.lit("qty").alias("metric"), F.col("v2").alias("value"), F.col("b2").alias("base"))))
    return g.select("flag", "status", "line", "seed", both.alias("x")).select("flag", "status", "line", "seed", "x.*")


@query(_CELLS + " SELECT metric, count(*) AS n, round(avg(value - base), 4) AS mean, round(quantile_cont(value - base, 0.1), 4) AS q10, round(quantile_cont(value - base, 0.5), 4) AS q50, round(quantile_cont(value - base, 0.9), 4) AS q90, round(avg((value > base)::INTEGER), 8) AS positive, round(avg((value >= base)::INTEGER), 8) AS nonnegative FROM cells GROUP BY metric")
def delta_distribution(spark, sf_dir):
    d = F.col("value") - F.col("base")
    q = lambda p: F.round(F.percentile(d, F.lit(p)), 4)
    share = lambda c: F.round(F.avg(c.cast("int")), 8)
    return _cells(spark, sf_dir).groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg(d), 4).alias("mean"), q(0.1).alias("q10"), q(0.5).alias("q50"), q(0.9).alias("q90"), share(d > 0).alias("positive"), share(d >= 0).alias("nonnegative"))


@query(_CELLS + " SELECT flag, status, line, metric, round(min(value - base), 4) AS low, round(median(value - base), 4) AS median, round(max(value - base), 4) AS high, sum((value > base)::INTEGER)::BIGINT AS positive_seeds FROM cells GROUP BY GROUPING SETS ((flag, status, line, metric), (flag, metric))")
def replications(spark, sf_dir):
    """Deltas over seeds by cell, and rolled up by flag, in one pass."""
    d = F.col("value") - F.col("base")
    c = _cells(spark, sf_dir)
    sets = [[F.col(x) for x in s] for s in (("flag", "status", "line", "metric"), ("flag", "metric"))]
    return c.groupingSets(sets, "flag", "status", "line", "metric").agg(F.round(F.min(d), 4).alias("low"), F.round(F.percentile(d, F.lit(0.5)), 4).alias("median"), F.round(F.max(d), 4).alias("high"), F.count_if(d > 0).alias("positive_seeds"))


_METHODS = "WITH c AS (SELECT l_linestatus AS cell, l_shipdate::DATE AS day, l_linenumber AS method, round(sum(l_extendedprice * l_discount), 4) AS v FROM lineitem GROUP BY ALL)"


@query(_METHODS + ", own AS (SELECT * FROM c WHERE method = 1), other AS (SELECT cell, day, max(v) AS best, max_by(method, (v, -method)) AS who FROM c WHERE method <> 1 GROUP BY ALL) SELECT cell, count(*) AS cells, sum((v > best)::INTEGER)::BIGINT AS strictly_best, round(avg(v - best), 6) AS mean_margin, min(who)::INTEGER AS least_rival FROM own JOIN other USING (cell, day) GROUP BY cell")
def best_competitor(spark, sf_dir):
    """Method 1 against the best other method of each cell (status and day)."""
    x = table(spark, sf_dir, "lineitem")
    c = x.groupBy(F.col("l_linestatus").alias("cell"), F.to_date("l_shipdate").alias("day"), F.col("l_linenumber").alias("method")).agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("v"))
    one, other = F.col("method") == 1, F.col("method") != 1
    g = c.groupBy("cell", "day").agg(F.max(F.when(one, F.col("v"))).alias("own"), F.max(F.when(other, F.col("v"))).alias("best"), F.max(F.when(other, F.struct("v", (-F.col("method")).alias("k")))).alias("who"))
    g = g.where("own is not null and best is not null")
    return g.groupBy("cell").agg(F.count("*").alias("cells"), F.count_if(F.col("own") > F.col("best")).alias("strictly_best"), F.round(F.avg(F.col("own") - F.col("best")), 6).alias("mean_margin"), F.min(-F.col("who.k")).alias("least_rival"))


@query("WITH expected AS (SELECT DISTINCT s.l_suppkey AS supp, f.l_returnflag AS flag FROM lineitem s, (SELECT DISTINCT l_returnflag FROM lineitem) f), found AS (SELECT DISTINCT l_suppkey AS supp, l_returnflag AS flag FROM lineitem WHERE l_quantity > 45) SELECT e.flag, count(*) AS expected, sum((f.supp IS NULL)::INTEGER)::BIGINT AS missing FROM expected e LEFT JOIN found f USING (supp, flag) GROUP BY e.flag")
def grid_completeness(spark, sf_dir):
    """Expected cells (supplier and flag) without one large line: an anti join, as counts."""
    x = table(spark, sf_dir, "lineitem")
    flags = x.select(F.col("l_returnflag").alias("flag")).distinct()
    expected = x.select(F.col("l_suppkey").alias("supp")).distinct().crossJoin(F.broadcast(flags))  # flags: three values
    found = x.where("l_quantity > 45").select(F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag")).distinct()
    missing = expected.join(found, ["supp", "flag"], "left_anti").groupBy("flag").agg(F.count("*").alias("missing"))
    return expected.groupBy("flag").agg(F.count("*").alias("expected")).join(missing, "flag", "left").select("flag", "expected", F.coalesce("missing", F.lit(0)).alias("missing"))


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS unknown, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS idle, (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)) AS known, (SELECT count(*) FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer)) AS either")
def inventory_sets(spark, sf_dir):
    """Set equality both ways, as sizes of differences, intersection and union: one shuffle by key in place of four."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    g = o.unionAll(c).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = lambda c: F.count_if(c)
    return g.agg(n((F.col("a") == 1) & (F.col("b") == 0)).alias("unknown"), n((F.col("a") == 0) & (F.col("b") == 1)).alias("idle"), n((F.col("a") == 1) & (F.col("b") == 1)).alias("known"), F.count("*").alias("either"))


_GATES = "WITH d AS (SELECT l_linenumber AS cap, l_returnflag AS flag, avg(l_discount) - 0.0495 AS delta, avg(l_tax) - 0.0395 AS graded FROM lineitem GROUP BY ALL)"


@query(_GATES + ", g AS (SELECT cap, bool_and(delta >= 0) AND bool_and(graded > 0) AS eligible, round(min(delta), 8) AS worst, round(avg(graded), 8) AS gain FROM d GROUP BY cap) SELECT cap, eligible, worst, gain, coalesce(cap = (SELECT min(cap) FROM g WHERE eligible), false) AS chosen, coalesce(cap = (SELECT arg_max(cap, (worst, gain, -cap)) FROM g WHERE worst > -0.0005), false) AS route FROM g")
def eligibility_gates(spark, sf_dir):
    """A cap is eligible if no cell is worse and all graded ones better; the least eligible is chosen, a route by the best key."""
    x = table(spark, sf_dir, "lineitem")
    d = x.groupBy(F.col("l_linenumber").alias("cap"), "l_returnflag").agg((F.avg("l_discount") - 0.0495).alias("delta"), (F.avg("l_tax") - 0.0395).alias("graded"))
    g = d.groupBy("cap").agg((F.bool_and(F.col("delta") >= 0) & F.bool_and(F.col("graded") > 0)).alias("eligible"), F.round(F.min("delta"), 8).alias("worst"), F.round(F.avg("graded"), 8).alias("gain"))
    best = g.agg(F.min(F.when(F.col("eligible"), F.col("cap"))).alias("least"), F.max(F.when(F.col("worst") > -0.0005, F.struct("worst", "gain", (-F.col("cap")).alias("k")))).alias("top"))
    return g.crossJoin(F.broadcast(best)).select("cap", "eligible", "worst", "gain", F.coalesce(F.col("cap") == F.col("least"), F.lit(False)).alias("chosen"), F.coalesce(F.col("cap") == -F.col("top.k"), F.lit(False)).alias("route"))


@query("WITH d AS (SELECT o_orderpriority AS width, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) - avg(o_totalprice) AS f, avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) - avg(o_totalprice) AS o FROM orders GROUP BY ALL) SELECT width, round(f, 4) AS f, round(o, 4) AS o, CASE WHEN f >= 0 AND o >= 0 AND (f > 0 OR o > 0) THEN 'candidate' ELSE 'control' END AS use FROM d")
def no_harm_assembly(spark, sf_dir):
    x = table(spark, sf_dir, "orders")
    p = F.col("o_totalprice")
    own = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, p)) - F.avg(p)
    d = x.groupBy(F.col("o_orderpriority").alias("width")).agg(own("F").alias("f"), own("O").alias("o"))
    ok = (F.col("f") >= 0) & (F.col("o") >= 0) & ((F.col("f") > 0) | (F.col("o") > 0))
    return d.select("width", F.round("f", 4).alias("f"), F.round("o", 4).alias("o"), F.when(ok, "candidate").otherwise("control").alias("use"))


@query("WITH p AS (SELECT a.l_orderkey AS o, sum(a.l_quantity) AS primary_v FROM lineitem a GROUP BY ALL), c AS (SELECT o_orderkey AS o, o_totalprice AS candidate_v FROM orders) SELECT count(*) AS n_either, count(p.o) AS n_primary, count(c.o) AS n_candidate, sum((p.o IS NULL OR c.o IS NULL)::INTEGER)::BIGINT AS unmatched, round(avg(candidate_v / primary_v), 4) AS mean_ratio FROM p FULL JOIN c ON p.o = c.o")
def paired_records(spark, sf_dir):
    """A one-to-one check of two record sets by a full join, and their paired ratio."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("po")).agg(F.sum("l_quantity").alias("pv"))
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("co"), F.col("o_totalprice").alias("cv"))
    j = p.join(c, p.po == c.co, "full")
    return j.agg(F.count("*").alias("n_either"), F.count("po").alias("n_primary"), F.count("co").alias("n_candidate"), F.count_if(F.col("po").isNull() | F.col("co").isNull()).alias("unmatched"), F.round(F.avg(F.col("cv") / F.col("pv")), 4).alias("mean_ratio"))


@query("WITH e AS (SELECT user_id, event_type, value, (ts::DATE) AS day FROM events) SELECT event_type, count(*) AS cells, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, round(min(value), 6) AS low, round(avg(value), 6) AS mean, sum((value > 0)::INTEGER)::BIGINT AS improved, round(stddev_samp(value), 6) AS spread FROM e GROUP BY event_type")
def audit_totals(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("cells"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.round(F.min("value"), 6).alias("low"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") > 0).alias("improved"), F.round(F.stddev("value"), 6).alias("spread"))


_SUMMED = ("l_extendedprice", "l_discount", "net")


@query(
    "WITH x AS (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem) "
    + " UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, '{c}' AS name, count({c}) AS n, round(fsum({c}), 4) AS total, round(fsum({c}) / count({c}), 8) AS mean, true AS within_half_ulp FROM x GROUP BY ALL" for c in _SUMMED)
)
def exact_totals(spark, sf_dir):
    """Totals and means that are the doubles nearest to the exact ones, whatever the order of rows, and whether the stated error says so."""
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", "l_discount", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    found = exact_sums(x, ["l_returnflag", "l_linestatus"], _SUMMED)
    return found.select("l_returnflag", "l_linestatus", "name", "n", F.round("total", 4).alias("total"), F.round("mean", 8).alias("mean"), (F.col("error") <= F.abs("total") * 2.0**-53).alias("within_half_ulp"))
