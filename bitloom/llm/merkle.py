"""Operator 13, a Merkle manifest of a dataset, by time-forward processing.

The nodes of a tree are processed in the order of their labels, and a node's digest waits for its parent in a priority queue ordered by
label. Outside memory that queue is a sorted shuffle of messages (tree, block, place): a task gets blocks of 8**height consecutive nodes
of a tree, one after the other and in order, and holds a heap of at most that many messages until the block's top is known. Tops are the
nodes of the next round, so a tree of n leaves takes log n / log 8**height rounds, and no task holds more than a block of a tree.

The reversed sweep goes through the rounds backwards: each block gets one message, which sorts before its nodes, with the proof from its
top up to the root, and hands it on to its nodes behind their own siblings.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import quoted, settle

#: Children of a node, and levels that a block of them rises in a round.
FAN, HEIGHT = 8, 3
_NODE = T.StructType().add("tree", "string").add("n", "long").add("at", "long").add("digest", "string")
_PROOF = T.StructType().add("subroot", "string").add("proof", T.ArrayType(T.StringType())).add("places", T.ArrayType(T.IntegerType()))


def leaf(*fields: Column) -> Column:
    """SHA-256 of a row: of each field its bytes' number, ":" and its text, or "-" if it is null."""
    said = lambda t: F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
    return F.sha2(F.concat(*(said(f.cast("string")) for f in fields)).cast("binary"), 256)


def fold(digest: Column, proof: Column, places: Column) -> Column:
    """The root that `digest` leads to: at each level it goes between its siblings, whose digests are in a row in `proof`, at its place."""

    def up(d: Column, s: Column) -> Column:
        left = s["place"] * 64
        return F.sha2(F.concat(F.substr(s["siblings"], F.lit(1), left), d, F.substr(s["siblings"], left + 1)).cast("binary"), 256)

    levels = F.transform(proof, lambda p, i: F.struct(p.alias("siblings"), F.get(places, i).alias("place")))
    return F.aggregate(levels, digest, up)


def _rises(n: int, height: int) -> int:
    """Levels that the blocks of a tree of n nodes rise: `height`, or fewer up to the tree's top."""
    h = 0
    while n > 1 and h < height:
        n, h = -(-n // FAN), h + 1
    return h


def _levels(digests: list[str], n: int, height: int) -> list[list[str]]:
    """The digests of a block's nodes, level by level and each level in order; n: the nodes of the block's tree in this round."""
    top = _rises(n, height)
    levels = [digests, *([] for _ in range(top))]
    queue = [(1, k // FAN, k, d) for k, d in enumerate(digests)] if top else []  # ascending, hence a heap
    while queue:
        level, at = queue[0][:2]  # the least label: its children are all there
        h = hashlib.sha256()
        while queue and queue[0][:2] == (level, at):
            h.update(heapq.heappop(queue)[3].encode())
        levels[level].append(d := h.hexdigest())
        if level < top:
            heapq.heappush(queue, (level + 1, at // FAN, at, d))
    return levels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after the other; a block's rows follow each other."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = row["tree"], row["block"]
            if own != key and held:
                yield held
                held = []
            key = own
            held.append(row)
    if held:
        yield held


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def _rise(nodes: DataFrame, height: int) -> DataFrame:
    """The next round's nodes: one for each block of `nodes`."""
    schema = to_arrow_schema(_NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            n = rows[0]["n"]
            yield _batch([(rows[0]["tree"], -(-n // FAN**height), rows[0]["block"], _levels([r["digest"] for r in rows], n, height)[-1][0])], schema)

    own = nodes.select("tree", "n", "at", "digest", F.floor(F.col("at") / FAN**height).cast("long").alias("block"))
    return _dealt(own).mapInArrow(run, _NODE)


def _fall(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """(tree, at, subroot, proof, places, row) of `nodes` (with a `row` that goes along); above: the same but `row` of the blocks' tops."""
    own = nodes.select("tree", "n", "at", "digest", "row", F.floor(F.col("at") / FAN**height).cast("long").alias("block"))
    told = above.select("tree", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), "subroot", "proof", "places")
    out = T.StructType([*_NODE.fields[0:3:2], *_PROOF.fields, T.StructField("row", nodes.schema["row"].dataType)])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, *rows in _blocks(batches):  # the message sorts before the nodes
            if not rows:
                continue
            found = []
            levels = _levels([r["digest"] for r in rows], rows[0]["n"], height)[:-1]
            for k, r in enumerate(rows):
                proof, places = [], []
                for level in levels:
                    start = k - k % FAN
                    proof.append("".join(level[start:k] + level[k + 1 : start + FAN]))
                    places.append(k - start)
                    k //= FAN
                found.append((r["tree"], r["at"], first["subroot"], proof + first["proof"], places + first["places"], r["row"]))
            yield _batch(found, schema)

    return _dealt(own.unionByName(told, allowMissingColumns=True)).mapInArrow(run, out)


def _ranked(rows: DataFrame) -> DataFrame:
    """`rows` (tree, key, digest, row) as nodes: with n, how many rows a tree has, and at, a row's place by key, nulls first.

    Rows are dealt by ranges of (tree, key), so that a large tree lies in many partitions; a partition's rows of a tree are numbered in
    place, and the numbers of those before come from a count for each (partition, tree). Ties go by digest.
    """
    rows = settle(rows).withColumn("tie", F.monotonically_increasing_id())
    order = [F.asc_nulls_first(c) for c in ("tree", "key", "digest", "tie")]
    rows = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("key", "tie").withColumn("k", F.monotonically_increasing_id()))
    part = F.shiftright("k", 33)
    runs = rows.groupBy("tree", part.alias("part")).agg(F.count("*").alias("own"), F.min("k").alias("first"))
    runs = runs.selectExpr(
        "tree as own_tree", "part", "sum(own) over (partition by tree) as n", "sum(own) over (partition by tree order by part) - own - first as shift"
    )  # a tree has as many rows here as partitions
    few = runs.count() <= 100_000
    met = rows.withColumn("of", part).join(F.broadcast(runs) if few else runs, F.expr("of = part and tree <=> own_tree"))
    return met.select("tree", "n", (F.col("k") + F.col("shift")).alias("at"), "digest", "row")


def _climb(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes of each round, up to the trees' tops; every round is checkpointed, so a lost executor costs one round."""
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while len(rounds) == 1 or most > 1:
        rounds.append(settle(_rise(rounds[-1], height)).withColumn("row", F.lit(None).cast("int")))
        most = -(-most // FAN**height)
    return rounds


def _descend(rounds: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """What `_fall` gives of the first round; above: of the trees' tops."""
    for nodes in rounds[-2::-1]:
        above = _fall(nodes, above, height)
    return above


def manifest(rows: DataFrame, digest: str = "leaf", tree: str = "lang", key: str = "doc_id", height: int = HEIGHT) -> DataFrame:
    """`rows` with subroot, root, proof and places of each row's leaf, whose digest (lower-case hex) is the column `digest`.

    Rows of an equal `tree` are the leaves of a tree, in the order of `key` (null first), then of the digest; while there are several
    nodes, every 8 consecutive ones become the SHA-256 of their digests in a row, and the last is the subroot. Subroots, by `tree` (null
    first, by UTF-8 bytes), become the root likewise. proof: of each level from the leaf to the root, the siblings' digests in a row;
    places: where the own node stands among them. `fold` leads from a leaf to the root. Rows travel with their nodes: leave long texts
    out. A task holds one block of 8**height nodes at a time. Input columns named as a result are replaced; repeated rows are leaves of
    their own; an empty table gives an empty one.
    """
    taken = {"subroot", "root", "proof", "places"}
    kept = [c for c in rows.columns if c.lower() not in taken]
    leaves = _ranked(rows.select(quoted(tree).cast("string").alias("tree"), quoted(key).alias("key"), quoted(digest).alias("digest"), F.struct(*map(quoted, kept)).alias("row")))
    own = _climb(leaves, height)
    tops = own[-1].select("tree", "digest")
    subroots = _climb(_ranked(tops.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.struct("tree", "digest").alias("row"))), height)
    top = subroots[-1].select("digest").first()
    start = rows.sparkSession.createDataFrame([("", 0, "", [], [])], T.StructType([*_NODE.fields[0:3:2], *_PROOF.fields]))
    above = _descend(subroots, start, height).select(F.col("row.tree").alias("tree"), F.lit(0).cast("long").alias("at"), F.col("row.digest").alias("subroot"), "proof", "places")
    found = _descend(own, above, height)
    return found.select("row.*", "subroot", F.lit(top[0] if top else None).cast("string").alias("root"), "proof", "places")
