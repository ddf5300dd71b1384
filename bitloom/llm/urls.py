"""Operator 8, URL filters: rules first, then the log-likelihood ratio of two character models.

DataFrame operations alone. The URLs that rules allow or block train one smoothed variable-order Markov model each. Characters fall
into 32 symbols and contexts have up to three of them, so the models are tables of at most 2**20 rows, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_unevenly, settle

#: Symbols by number: the edge, letters, any digit, three marks and anything else.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0/.-~"
#: A context seen less often than this in a class is left for the next shorter one.
LEAST_SEEN = 2
#: Scores are sums of whole millionths, so that they don't depend on the order of summing; thresholds are thousandths a character.
UNIT = 1_000_000


def parts(url: Column) -> tuple[Column, Column]:
    """host and path of a URL; both empty if it is null or has no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of `rules` (verdict, "host/path") that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # later ones, which are longer, go before
        own, _, begin = r.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{begin}")
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _symbols(url: Column) -> Column:
    after = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^:/?#]*://", "")
    plain = F.regexp_replace(F.translate(F.lower(after), "123456789", "000000000"), r"[^a-z0/.\-]", "~")
    return F.concat(F.lit("^^^"), plain, F.lit("^"))


def grams(urls: DataFrame) -> DataFrame:
    """(url, allowed, g) for each character of `urls` and its end; g: four symbols, the three before and its own, as 20 bits."""
    s = urls.select("url", "allowed", _symbols(F.col("url")).alias("s"))
    codes = F.expr(f"transform(split(s, ''), c -> locate(c, '{ALPHABET}') - 1)")
    return s.select("url", "allowed", codes.alias("c")).select("url", "allowed", F.explode(F.expr("transform(sequence(3, size(c) - 1), i -> c[i-3] * 32768 + c[i-2] * 1024 + c[i-1] * 32 + c[i])")).alias("g"))


def model(counts: DataFrame) -> DataFrame:
    """(g, v): for every g, UNIT times the logarithm of its last symbol's probability if allowed less that if blocked.

    counts: (g, yes, no). Witten-Bell smoothing, from no context up to three symbols: P(c|x) = (n(xc) + kinds(x) P'(c|x')) / (n(x) +
    kinds(x)), where x' is x less its first symbol; P' alone where x was seen less than LEAST_SEEN times.
    """
    out = counts.sparkSession.range(1 << 20).select(F.col("id").cast("int").alias("g"))
    out = out.withColumns({"p_yes": F.lit(1 / 32), "p_no": F.lit(1 / 32)})
    for order in range(4):
        size = 1 << 5 * (order + 1)
        own = counts.groupBy((F.col("g") % size).alias("k")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        before = own.groupBy(F.shiftright("k", 5).alias("x")).agg(*(f(c).alias(f"{c}_{n}") for c in ("yes", "no") for n, f in (("all", F.sum), ("kinds", lambda c: F.sum((F.col(c) > 0).cast("long"))))))
        out = out.withColumn("k", F.col("g") % size).withColumn("x", F.shiftright("k", 5)).join(before, "x", "left").join(own, "k", "left")
        for c in ("yes", "no"):
            seen, kinds = F.col(f"{c}_all"), F.col(f"{c}_kinds")
            p = (F.coalesce(c, F.lit(0)) + kinds * F.col(f"p_{c}")) / (seen + kinds)
            out = out.withColumn(f"p_{c}", F.when(seen >= LEAST_SEEN, p).otherwise(F.col(f"p_{c}")))
        out = out.select("g", "p_yes", "p_no")
    return out.select("g", F.round((F.log("p_yes") - F.log("p_no")) * UNIT).cast("long").alias("v"))


def judge(df: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, verdict, score) for every row of `df`.

    verdict: the rule's; else allow if the URL's score reaches the threshold, block if not. score: the log-likelihood difference for
    a character, in thousandths. Of the URLs that rules decide, those whose MD5 begins with 0 to 3 train nothing: on them the threshold
    has the least sum of the shares of wrongly judged URLs, at its lowest value. Where this or the other part lacks a class, all train and
    all are judged by. Each distinct URL counts once, and one that crowds the table is joined apart. Where rules allow or block no URL,
    nothing can be learnt: undecided ones are allowed. Very long URLs are whole, an empty table gives an empty one.
    Null URLs count as empty texts and have empty host and path. Repeated rows stay; other columns are not read.
    """
    rows = df.select(df[f"`{page_id}`"].alias("page_id"), df[f"`{url}`"].cast("string").alias("raw")).withColumn("url", F.coalesce("raw", F.lit("")))
    host, path = parts(F.col("url"))
    _, says = rule_for(F.col("host"), F.col("path"), rules)
    held = F.substring(F.md5(F.col("url").cast("binary")), 1, 1) < "4"
    urls = rows.groupBy("url").agg(F.count("*").alias("times")).withColumns({"host": host, "path": path})
    urls = settle(urls.select("url", "times", (says == "allow").alias("allowed"), held.alias("held")))
    decided = urls.where("allowed is not null")
    apart = decided.select("allowed", "held").distinct().count() == 4
    train = decided.where("not held") if apart else decided
    counts = settle(grams(train).groupBy("g").agg(F.sum(F.col("allowed").cast("long")).alias("yes"), F.sum((~F.col("allowed")).cast("long")).alias("no")))
    scored = grams(urls).join(F.broadcast(model(counts)), "g").groupBy("url", "allowed").agg(F.floor(F.sum("v") * 1000 / F.count("*") / UNIT).cast("long").alias("score"))
    scored = settle(scored.join(urls.select("url", "times", "held"), "url"))
    judged = scored.where("allowed is not null and held") if apart else scored.where("allowed is not null")
    bins = judged.groupBy(F.greatest(F.lit(-20000), F.least(F.lit(20000), "score")).alias("at")).agg(F.sum(F.col("allowed").cast("long")).alias("yes"), F.sum((~F.col("allowed")).cast("long")).alias("no"))
    totals = bins.agg(F.sum("yes"), F.sum("no")).first()
    if totals[0] and totals[1]:
        # bins are at most 40,001 rows: the running sums are over a bounded table
        run = bins.selectExpr("at", "sum(yes) over (order by at) - yes as missed", f"{totals[1]} - (sum(no) over (order by at) - no) as passed")
        threshold = run.orderBy(F.col("missed") / totals[0] + F.col("passed") / totals[1], "at").first()[0]
    else:
        threshold = None
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    learnt = F.lit("allow") if threshold is None else F.when(F.col("score") >= threshold, "allow").otherwise("block")
    joined = join_unevenly(rows, scored.select("url", "times", "score"), "url", "times").withColumns({"host": host, "path": path})
    return joined.select("page_id", F.col("raw").alias("url"), "host", "path", rule.alias("rule"), F.coalesce(says, learnt).alias("verdict"), "score")
