"""Queries on collections of items: adapters, gates, logs and written shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import unit_faults
from ..operators import gate, ledger, rank
from ..sources import adapters, readers, sinks
from ..sources.items import codes, items, with_split
from ..sources.tables import table
from ..streaming.chunks import shared_folder
from .registry import ITEMS, PAIRS, query
from .retrieval import rounded


@query(
    "WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus || l_partkey AS caption, l_suppkey % 7 AS label FROM lineitem), t AS (SELECT l_orderkey, list(caption ORDER BY l_linenumber, caption) AS texts, list_sort(list(DISTINCT label)) AS labels FROM l GROUP BY 1) "
    "SELECT o_orderkey AS source_id, array_to_string(texts, '|') AS texts, labels FROM orders JOIN t ON l_orderkey = o_orderkey"
)
def captioned_items(spark, sf_dir):
    """Orders in two parts as images, their lines as captions and their suppliers' groups as categories."""
    o, x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id")), table(spark, sf_dir, "lineitem")
    caption = F.concat("l_returnflag", "l_linestatus", "l_partkey")
    captions = x.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("caption_id"), caption.alias("caption"))
    categories = x.select(F.col("l_orderkey").alias("image_id"), (F.col("l_suppkey") % 7).alias("label"))
    two = lambda df: [df.where("image_id % 2 = 0"), df.where("image_id % 2 = 1")]  # noqa: E731  both parts together are the whole
    return adapters.captioned(two(o), two(captions), two(categories)).select("source_id", F.array_join("texts", "|").alias("texts"), "labels")


@query(
    "WITH t AS (SELECT conv_id, list(role ORDER BY turn, role) AS texts FROM conversations GROUP BY 1), c AS (SELECT doc_id, list_sort(list(DISTINCT toxic + 2 * quality)) AS labels FROM labels GROUP BY 1) "
    f"SELECT 'd' || d.doc_id AS source_id, array_to_string(coalesce(texts, ['{adapters.FALLBACK}']), '|') AS texts, coalesce(labels, []) AS labels FROM documents d LEFT JOIN t ON conv_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"
)
def indexed_items(spark, sf_dir):
    found = adapters.indexed(*_indexed(spark, sf_dir))
    return found.select("source_id", F.array_join("texts", "|").alias("texts"), "labels")


def _indexed(spark, sf_dir):
    """Documents by number, the roles of the conversation of that number as tags, and marks as labels."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("raw_index"), F.concat(F.lit("d"), "doc_id").alias("source_id"))
    tags = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("raw_index"), F.col("turn").alias("position"), F.col("role").alias("tag"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("raw_index"), (F.col("toxic") + 2 * F.col("quality")).alias("label"))
    return rows, tags, labels


@query(
    "WITH t AS (SELECT conv_id AS k, count(*) AS n, min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS kinds FROM conversations GROUP BY 1), d AS (SELECT doc_id AS k, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1), "
    "v AS (SELECT 'tags.positions' AS rule, k FROM t WHERE low <> 0 OR high <> n - 1 OR kinds <> n UNION ALL SELECT 'tags.stray', k FROM t WHERE k NOT IN (SELECT k FROM d) "
    "UNION ALL SELECT DISTINCT 'labels.stray', doc_id FROM labels WHERE doc_id NOT IN (SELECT k FROM d) UNION ALL SELECT 'rows.repeated', k FROM d WHERE n > 1) SELECT rule, count(*) AS ids, min(k) AS example FROM v GROUP BY rule"
)
def index_faults(spark, sf_dir):
    """What is wrong where every third document is missing: tags and labels without a row, and broken orders of tags."""
    rows, tags, labels = _indexed(spark, sf_dir)
    return adapters.index_faults(rows.where("raw_index % 3 <> 0"), tags, labels)


@query(
    "WITH valid AS (SELECT event_type FROM events GROUP BY 1 HAVING count(*) * (SELECT count(DISTINCT event_type) FROM events) >= (SELECT count(*) FROM events)), "
    "t AS (SELECT user_id, list_sort(list(DISTINCT 'a photo of ' || event_type)) AS texts FROM events WHERE event_type IN (SELECT event_type FROM valid) GROUP BY 1), c AS (SELECT user_id, list_sort(list(DISTINCT (event_id % 24)::INTEGER)) AS labels FROM events GROUP BY 1) "
    "SELECT user_id AS source_id, texts, labels FROM t JOIN c USING (user_id)"
)
def tagged_items(spark, sf_dir):
    """Users as photos, tagged by the event types that are common enough for the dictionary, in 24 groups."""
    e = table(spark, sf_dir, "events")
    counts = e.groupBy("event_type").agg(F.count("*").alias("n"))  # a row for each type
    mean = counts.agg(F.avg("n").alias("mean"))
    valid = counts.join(F.broadcast(mean), F.col("n") >= F.col("mean")).select(F.col("event_type").alias("tag"))
    return adapters.tagged(e.select(F.col("user_id").alias("photo_id"), F.col("event_type").alias("tag")), valid, e.select(F.col("user_id").alias("photo_id"), (F.col("event_id") % 24).cast("int").alias("label")))


@query(f"WITH {PAIRS} SELECT direction, qid, r, n, m::BIGINT AS m, round(g, 8) AS g FROM shells WHERE bits = 16")
def gated_shells(spark, sf_dir):
    """Shells of ranks that were frozen before any label was read; the labels come from the items only then."""
    rows = items(spark, sf_dir)
    split = with_split(rows)
    q, d = rank.directed(codes(split).where("bits = 16"))
    frozen = gate.freeze(q.drop("qlabel", "qlabels"), d.drop("dlabel", "dlabels"))
    return rounded(gate.measure(frozen, rows.select("id", "labels")).select("direction", "qid", "r", "n", "m", "g"))


@query("SELECT event_type, count(*) AS n, sum((event_id % 9 <> 0)::INTEGER)::BIGINT AS valid FROM events GROUP BY 1")
def event_log_checks(spark, sf_dir):
    """All events as a log of JSON lines that hold their own hash; every ninth was changed after it had been hashed."""
    folder = shared_folder(spark)
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    hashed = e.withColumn("sha256", F.sha2(F.to_json(F.struct("event_id", "event_type", "user_id")).cast("binary"), 256))
    hashed.withColumn("user_id", F.when(F.col("event_id") % 9 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))).write.json(folder)
    log = readers.event_log(spark, folder, "event_id long, event_type string, user_id long", ["event_id", "event_type", "user_id"])
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"))


@query(
    "SELECT count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last, 0::BIGINT AS overlaps, 1::BIGINT AS lost, 1::BIGINT AS differs, (SELECT count(*) FROM orders) AS exported, "
    "(SELECT count(*) FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) FROM orders)) AS done FROM orders"
)
def written_shards(spark, sf_dir):
    """Orders in ranges of their keys with a receipt each: ranges don't overlap, and a lost and a changed receipt are told."""
    folder = shared_folder(spark)
    o = table(spark, sf_dir, "orders")
    sinks.shards(o, f"{folder}/shards", "o_orderkey", 5)
    sinks.csv(o, f"{folder}/csv")
    written = ledger.settled(sinks.receipts(spark.read.parquet(f"{folder}/shards"), "o_orderkey"))  # a row a shard
    edge = written.agg(F.min("shard"), F.max("shard")).first()
    expected = written.withColumn("digest", F.when(F.col("shard") == edge[1], F.col("digest") + 1).otherwise(F.col("digest")))
    faults = ledger.receipts_match(expected, written.where(F.col("shard") != edge[0]), "shard").agg(F.count_if(F.col("state") == "lost").alias("lost"), F.count_if(F.col("state") == "differs").alias("differs"))
    a, b = written.alias("a"), written.alias("b")
    overlaps = a.join(F.broadcast(b), F.expr("b.shard = a.shard + 1 and b.first <= a.last")).agg(F.count("*").alias("overlaps"))
    exported = spark.read.option("header", True).csv(f"{folder}/csv").agg(F.count("*").alias("exported"))
    todo = sinks.unfinished(o.select("o_orderkey"), spark.read.parquet(f"{folder}/shards"), "o_orderkey").agg(F.count("*").alias("todo"))
    whole = written.agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    for one in (overlaps, faults, exported, todo):  # a row each
        whole = whole.crossJoin(F.broadcast(one))
    return whole.withColumn("done", F.col("n") - F.col("todo")).drop("todo")


@query(
    f"WITH {ITEMS}, kept AS (SELECT id, (is_q AND id % 40 <> 1) OR id % 40 = 2 AS is_q, is_t AND id % 40 <> 3 AS is_t, is_d FROM split WHERE id % 40 <> 4), "
    "v AS (SELECT 'is_q' AS role, s.id FROM split s JOIN kept k USING (id) WHERE s.is_q <> k.is_q UNION ALL SELECT 'is_t', s.id FROM split s JOIN kept k USING (id) WHERE s.is_t <> k.is_t "
    "UNION ALL SELECT 'missing', id FROM split WHERE id % 40 = 4 UNION ALL SELECT 'is_q and is_d', id FROM kept WHERE is_q AND is_d UNION ALL SELECT 'neither', id FROM kept WHERE NOT is_q AND NOT is_d) "
    "SELECT role, count(*) AS ids, min(id) AS example FROM v GROUP BY role"
)
def split_audit(spark, sf_dir):
    """A stored split that was tampered with, held against the split that content hashes give: which roles differ, where and how often."""
    own = with_split(items(spark, sf_dir)).select("id", "is_q", "is_t", "is_d")
    folder, k = shared_folder(spark), F.col("id") % 40
    own.where(k != 4).select("id", ((F.col("is_q") & (k != 1)) | (k == 2)).alias("is_q"), (F.col("is_t") & (k != 3)).alias("is_t"), "is_d").write.parquet(folder)
    return split_faults(spark.read.parquet(folder), own)


def split_faults(stored: DataFrame, own: DataFrame) -> DataFrame:
    """(role, ids, example) where a stored split (id, is_q, is_t, is_d) differs from the recomputed one, in a grouping by id.

    missing and unknown: ids of one side alone; repeated: stored more than once; and rows that are in both parts or in neither.
    """
    roles = ("is_q", "is_t", "is_d")
    tell = lambda df, side: df.select("id", F.lit(side).alias("side"), *roles)
    of = lambda side, r: F.max(F.when(F.col("side") == side, F.col(r)))
    met = tell(stored, "s").unionAll(tell(own, "o")).groupBy("id").agg(F.count_if(F.col("side") == "s").alias("s"), F.count_if(F.col("side") == "o").alias("o"), *(of(x, r).alias(f"{x}_{r}") for x in "so" for r in roles))
    both = (F.col("s") > 0) & (F.col("o") > 0)
    rules = {r: both & (F.col(f"s_{r}") != F.col(f"o_{r}")) for r in roles}
    rules |= {"missing": F.col("s") == 0, "unknown": F.col("o") == 0, "repeated": F.col("s") > 1, "is_q and is_d": F.col("s_is_q") & F.col("s_is_d"), "neither": ~F.col("s_is_q") & ~F.col("s_is_d")}
    told = F.filter(F.array(*(F.when(bad, F.lit(r)) for r, bad in rules.items())), lambda r: r.isNotNull())
    return met.select("id", F.explode(told).alias("role")).groupBy("role").agg(F.count("*").alias("ids"), F.min("id").alias("example"))


@query(
    "WITH p AS (SELECT user_id, event_id, [value / 100, 1 - value / 100, 0.5] AS v FROM events) SELECT CASE WHEN event_id % 50 = 1 THEN 'width' WHEN list_min(v) < 0 OR list_max(v) > 1 THEN 'outside' ELSE 'good' END AS fault, count(*) AS n, min(event_id) AS example FROM p GROUP BY 1"
)
def posterior_checks(spark, sf_dir):
    """Posteriors of three numbers made from event values: what of them is not three numbers from 0 to 1."""
    v = F.col("value") / 100
    p = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 1, F.array(v)).otherwise(F.array(v, 1 - v, F.lit(0.5))).alias("v"))
    return p.groupBy(F.coalesce(unit_faults(F.col("v"), 3), F.lit("good")).alias("fault")).agg(F.count("*").alias("n"), F.min("event_id").alias("example"))
