"""Operator 7, near-duplicates by SimHash with deletion-variant signatures.

Fingerprints within 3 bits of each other agree, in one of their two 32-bit halves, up to one bit. So each distinct fingerprint is
indexed under its halves and under each half with one bit struck out; an equality on such a key finds every link, and the candidates
are verified on all 64 bits. Struck keys link only across the struck bit, as the whole halves have the other pairs already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_unevenly, quoted, settle, with_results
from .graph import components

SEED = 42
SHINGLE = 3
FAR = 3
#: Keys that more fingerprints than this may have are dealt by parts of the other half.
LIMIT = 4096
_BLOCK = 1 << 16
#: So many halves have a crowd at most for the keys to be broadcast.
MOST_CROWDED = 20_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 if it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < width:
        first, last = [0], [len(line)]
    else:
        first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), _BLOCK):
        own = np.array([hashed(line[a:b], SEED) for a, b in zip(first[at : at + _BLOCK], last[at : at + _BLOCK])], "<u8")
        ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with `fp`, the fingerprint as a signed long. Null and word-less texts: 0."""

    @F.pandas_udf("fp long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame({"fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)})

    return with_results(df, prints(df[f"`{text}`"].cast("string")), ["fp"])


def variants(prints: DataFrame) -> DataFrame:
    """(key, fp): 66 rows for each fingerprint. key: the half's number times 33 plus the struck bit (32: none), then the half itself."""
    v = F.explode(F.sequence(F.lit(0), F.lit(65))).alias("v")
    return prints.select("fp", v).selectExpr(
        "shiftleft(cast(v as bigint), 32) | (shiftrightunsigned(fp, 32 * (v div 33)) & 4294967295L & ~(if(v % 33 = 32, 0L, shiftleft(1L, cast(v % 33 as int))))) as key", "fp"
    )


def _forest(own: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Edges that join what links of up to FAR bits join, one fewer than nodes at most; with `side`, links across sides alone."""
    left = np.ones(len(own), bool)
    found: list[tuple[int, int]] = []
    for start in range(len(own)):
        if not left[start]:
            continue
        left[start] = False
        stack = [start]
        while stack:
            k = stack.pop()
            near = left & (np.bitwise_count((own ^ own[k]).view(np.uint64)) <= FAR)
            if side is not None:
                near &= side != side[k]
            for x in np.flatnonzero(near).tolist():
                found.append((k, x))
                stack.append(x)
            left &= ~near
    return found


def _link(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Verified edges (n x 2) of whole groups of equal, sorted keys."""
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(cuts, len(keys)))
    struck = (keys[cuts].astype(np.uint64) >> np.uint64(32)) & np.uint64(0x7F)
    half, bit = struck // np.uint64(33), struck % np.uint64(33)
    side = ((fps.view(np.uint64) >> np.repeat(half * np.uint64(32) + np.minimum(bit, np.uint64(31)), sizes)) & np.uint64(1)).astype(bool)
    some = np.add.reduceat(side.astype(np.int64), cuts)
    use = (sizes > 1) & ((bit == 32) | ((some > 0) & (some < sizes)))
    edges = []
    two = cuts[use & (sizes == 2)]
    near = two[np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= FAR] if len(two) else two
    edges.append(np.stack([fps[near], fps[near + 1]], 1))
    for g in np.flatnonzero(use & (sizes > 2)).tolist():
        a, b = cuts[g], cuts[g] + sizes[g]
        own = fps[a:b]
        if pairs := _forest(own, None if bit[g] == 32 else side[a:b]):
            edges.append(own[np.array(pairs)])
    return np.concatenate(edges)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) over rows (key, sub, fp) sorted by (key, sub); a group's rows wait for its last one."""
    rest: list[list[np.ndarray]] = []

    def done(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, sub, fp = (np.concatenate(x) for x in zip(*parts))
        if len(key):
            # groups by (key, sub): a number that keeps the key's upper part in sight
            at = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (sub[1:] != sub[:-1]))))
            edges = np.unique(np.sort(_link((key & ~np.int64(0xFFFFFFFF)) | at, fp), axis=1), axis=0)
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])

    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not len(now[0]):
            continue
        same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        cut = int(np.argmax(same))  # sorted: the last group begins at its first row
        if rest and (cut or rest[-1][0][-1] != now[0][0] or rest[-1][1][-1] != now[1][0]):
            yield from done([*rest, [x[:cut] for x in now]])
            rest = []
        elif cut:
            yield from done([[x[:cut] for x in now]])
        rest.append([x[cut:] for x in now])
    if rest:
        yield from done(rest)


def crowded(prints: DataFrame, limit: int) -> DataFrame:
    """(half): the keys of whole halves of which, struck or not, a key that more than `limit` of `prints` have can come.

    Fingerprints of a struck key have one of two whole halves, so one of these has more than half of them: counting whole halves, two
    rows a fingerprint, finds all of them, and none that fewer than `limit` / 2 fingerprints have.
    """
    whole = prints.select(F.explode(F.expr("array(shiftleft(32L, 32) | fp & 4294967295L, shiftleft(65L, 32) | shiftrightunsigned(fp, 32))")).alias("half"))
    return whole.groupBy("half").count().where(F.col("count") * 2 > limit).select("half")


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints `fp` that join exactly what all links of up to FAR bits join.

    Keys are dealt over the cluster; a key's rows meet in one task, which emits at most one edge fewer than rows. A key that more than
    `limit` rows may have is split before they meet: the other half is cut in two, and its rows go by each 16-bit part with one bit
    struck out (or none) to groups of which none can have more than 2**18 fingerprints.
    """
    rows = variants(prints).withColumn("sub", F.lit(0).cast("long"))
    halves = settle(crowded(prints, limit))
    n = halves.count()
    if n:
        struck = "explode(transform(sequence(0, 32), b -> half - shiftleft(cast(32 - b as bigint), 32) & ~(if(b = 32, 0L, shiftleft(1L, b))))) as hot"
        hot = halves.selectExpr(struck).distinct()
        marked = rows.join(F.broadcast(hot) if n <= MOST_CROWDED else hot, F.col("key") == F.col("hot"), "left")
        other = "shiftrightunsigned(fp, 32 * (1 - (shiftrightunsigned(key, 32) div 33))) & 4294967295L"
        part = f"shiftrightunsigned({other}, 16 * (w div 17)) & 65535L & ~(if(w % 17 = 16, 0L, shiftleft(1L, cast(w % 17 as int))))"
        split = marked.where("hot is not null").select("key", "fp", F.explode(F.sequence(F.lit(0), F.lit(33))).alias("w")).selectExpr("key", f"1 + (shiftleft(cast(w as bigint), 16) | ({part})) as sub", "fp")
        rows = marked.where("hot is null").select("key", "sub", "fp").union(split)
    dealt = rows.select("key", "sub", "fp").repartition("key", "sub").sortWithinPartitions("key", "sub")
    return dealt.mapInArrow(_groups, "u long, v long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root) for every row of `df`.

    component_id: the smallest doc_id among all rows whose fingerprints a chain of links of up to 3 differing bits reaches, own row
    included; null only where all those doc_ids are null. Equal fingerprints are one node, so copies cost one row each and no pairs.
    Null and word-less texts have fingerprint 0 and link like any other. Very long texts are read whole. Repeated rows stay repeated. An
    empty table gives an empty one. Other columns are not read.
    """
    read = df.select(quoted(doc_id).alias("doc_id"), quoted(text).cast("string").alias("text"))
    rows = settle(with_fingerprint(read, "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "fp"))
    distinct = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    roots = components(links(distinct.select("fp"), limit))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", "copies", F.coalesce("root", "fp").alias("root"))
    named = settle(member.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("nodes")))
    member = settle(join_unevenly(member, named, "root", "nodes"))
    return join_unevenly(rows, member, "fp", "copies").select("doc_id", "text_hash", "fp", "component_id", "root")


def one_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` that stand for their group of near-duplicates: of each, the row of the least doc_id, with all its columns.

    A null doc_id stands only where its whole group has none; ties go to the least hash of the text, then to any of equal rows. Texts
    move once, to meet the small table of those that stay.
    """
    found = near_duplicates(df, doc_id, text)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    own_id, own_hash, one_id, one_hash = fresh("id"), fresh("hash"), fresh("id"), fresh("hash")
    stay = found.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.doc_id").alias(one_id), F.col("m.text_hash").alias(one_hash))
    rows = df.withColumns({own_id: quoted(doc_id), own_hash: F.xxhash64(quoted(text).cast("string"))})
    rows = rows.join(stay, F.col(own_id).eqNullSafe(F.col(one_id)) & (F.col(own_hash) == F.col(one_hash)), "left_semi")
    return rows.dropDuplicates([own_id, own_hash]).drop(own_id, own_hash)
