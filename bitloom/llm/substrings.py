"""Operator 11, substring dedup: matching statistics of documents in suffix automata of reference shards.

A window of `window` words is repeated if its words also start in a document with a smaller id. Which texts have to meet is found by
anchors: the 16-gram of least hash in a window is a function of the window's words, so windows that are equal have equal anchors, at the
same place. Consecutive windows with one anchor are a stretch of at most 84 words. Stretches whose anchor is in a single document are
done with, and where all stretches of an anchor are alike the first document is known. Of the others each distinct one is fetched once
from the first document that has it, and the stretches of an anchor are a reference shard. A task builds the shard's suffix automaton, whose states know the first document that reaches them, and streams the
stretches through it: where the match is as long as a window, the state tells in which document the window stands first.

Automata are built where their shard is and not broadcast to all documents: repeated text grows with the corpus, and so would they. A
shard has at most CROWD stretches. Anchors with more, as of a passage in a third of all documents with other surroundings each time, are
cut into single windows, which are counted by 128-bit hashes with a partial aggregation before rows meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fresh, quoted, settle, with_results

#: Words in a window and in an anchor; stretches of an anchor that one automaton takes; rows of a side that may be broadcast.
WINDOW, GRAM, CROWD, FEW = 50, 16, 1_000, 1_000_000
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def stretches(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, content) of each stretch of `texts`: its text's number, first word, number of windows, and hashes."""
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    digest = xxhash.xxh64_intdigest
    h = _mixed(np.fromiter((digest(w) for own in words for w in own), np.uint64, n))
    row, begin = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
    g, wide = h, 1
    while wide < GRAM:  # hashes of 2, 4, 8 and 16 words
        g, wide = _mixed(g[:-wide] * np.uint64(_ODD + 2 * wide) + g[wide:]), 2 * wide
    ways, at, wide = window - GRAM + 1, np.arange(len(g)), 1
    while wide < ways:  # the first of the least hashes among `wide` places
        step = min(wide, ways - wide)
        left, right = at[:-step], at[step:]
        at, wide = np.where(g[right] < g[left], right, left), wide + step
    valid = np.flatnonzero(row[window - 1 :] == row[: n - window + 1])
    new = np.ones(len(valid), bool)
    new[1:] = (np.diff(valid) > 1) | (np.diff(at[valid]) != 0)
    first = np.flatnonzero(new)
    start, count = valid[first], np.diff(np.append(first, len(valid)))
    power = np.multiply.accumulate(np.full(n, _ODD, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power)])
    back = np.multiply.accumulate(np.full(n, _BACK, np.uint64))
    content = _mixed((total[start + count + window - 1] - total[start]) * back[start] + count.astype(np.uint64))
    return row[start], start - begin[row[start]], count, g[at[start]].view(np.int64), content.view(np.int64)


class Automaton:
    """The suffix automaton of several sequences of words, each from a document; documents are added in ascending order.

    first[v]: the first document in which the words of state v occur. A state is made by the first document that reaches it, and one
    that is split off has been reached by whatever reached the whole.
    """

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def _state(self, next_: dict[bytes, int], link: int, length: int, first: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state for p's longest words and `word`, taken out of q where q also has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
        self.link[q] = own
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = own
            p = self.link[p]
        return own

    def add(self, words: list[bytes], doc: int) -> None:
        last = 0
        for word in words:
            if (q := self.next[last].get(word)) is not None:
                last = self._split(last, word, q)
                continue
            own, p = self._state({}, 0, self.length[last] + 1, doc), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = own
                p = self.link[p]
            if p >= 0:
                self.link[own] = self._split(p, word, self.next[p][word])
            last = own

    def firsts(self, words: list[bytes], window: int) -> list[int | None]:
        """Of each window of `words`: the first document that has it, None if none does."""
        v = matched = 0
        out: list[int | None] = []
        for k, word in enumerate(words):
            while v and word not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if (to := self.next[v].get(word)) is not None:
                v, matched = to, matched + 1
            while v and self.length[self.link[v]] >= window:  # the state that has the last `window` words
                v = self.link[v]
                matched = self.length[v]
            if k >= window - 1:
                out.append(self.first[v] if matched >= window else None)
        return out


def _anchored(rows: DataFrame, window: int) -> DataFrame:
    """(a, c, id, th, s, r): the stretches of `rows` (id, text, th), whose first word is s and which have r windows."""
    schema = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("r", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hashes = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            at = 0
            for some in blocks(batch.column(1).to_pandas(), 1_000_000):
                row, s, r, a, c = stretches([t.encode() for t in some], window)
                row = row + at
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, c, docs[row], hashes[row], s.astype(np.int32), r.astype(np.int32))], schema=schema)
                at += len(some)

    return rows.mapInArrow(run, "a long, c long, id long, th long, s int, r int")


def _side(df: DataFrame) -> DataFrame:
    """`df`, which is checkpointed, as a join's side: broadcast if it has few rows, which are a few numbers each."""
    return F.broadcast(df) if df.count() <= FEW else df


def _fetched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """`rows` with the stretches `own` that `wanted` (id, th, a, c, s, r) has of them. Texts that have none don't move, if few have."""
    wanted = settle(wanted.groupBy("id", "th").agg(F.collect_list(F.struct("a", "c", "s", "r")).alias("own")))
    keys = wanted.select("id", "th")
    if keys.count() <= FEW:
        rows = rows.join(F.broadcast(keys), ["id", "th"], "left_semi")
    return rows.join(wanted.hint("merge"), ["id", "th"])


def _by_automata(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(a, c, firsts) of the stretches `wanted`: of each of their windows, the first document that has it."""
    cut = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("id", pa.int64()), ("words", pa.binary())])
    told = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("firsts", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, doc = batch.column(0)[k].as_py().encode().split(), batch.column(1)[k].as_py()
                own = batch.column(2)[k].as_py()
                for at in range(0, len(own), 10_000):
                    some = own[at : at + 10_000]
                    found = [[x["a"] for x in some], [x["c"] for x in some], [doc] * len(some), [b" ".join(words[x["s"] : x["s"] + x["r"] + window - 1]) for x in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(found, cut)], schema=cut)

    def shard(rows: list[tuple[int, int, list[bytes]]]) -> list[list[int]]:
        automaton = Automaton()
        for _, doc, words in rows:
            automaton.add(words, doc)
        return [automaton.firsts(words, window) for _, _, words in rows]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, held = None, []

        def done() -> pa.RecordBatch:
            found = [[anchor] * len(held), [c for c, _, _ in held], shard(held)]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(found, told)], schema=told)

        ready = []
        for batch in batches:
            for a, c, doc, words in zip(*(col.to_pylist() for col in batch.columns)):
                if a != anchor:
                    if held:
                        ready.append(done())
                    anchor, held = a, []
                if not held or held[-1][0] != c:  # repeated rows follow each other
                    held.append((c, doc, words.split()))
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                ready = []
        if held:
            yield done()

    words = _fetched(rows, wanted).select("text", "id", "own").mapInArrow(read, "a long, c long, id long, words binary")
    return words.repartition("a").sortWithinPartitions("a", "id", "c").mapInArrow(match, "a long, c long, firsts array<long>")


def _by_windows(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """As `_by_automata`, by single windows: those of crowded anchors, that meet by their hash after they have been counted in part."""
    schema = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("id", pa.int64()), ("j", pa.int32()), ("w", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, doc, own in zip(*(col.to_pylist() for col in batch.columns)):
                words = text.encode().split()
                found = [(x["a"], x["c"], doc, j, hashlib.md5(b" ".join(words[x["s"] + j : x["s"] + j + window])).digest()) for x in own for j in range(x["r"])]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), schema)], schema=schema)

    windows = settle(_fetched(rows, wanted).select("text", "id", "own").mapInArrow(read, "a long, c long, id long, j int, w binary"))
    least = windows.groupBy("w").agg(F.min("id").alias("least"))
    told = windows.join(least, "w").groupBy("a", "c").agg(F.sort_array(F.collect_set(F.struct("j", "least"))).alias("all"))
    return told.select("a", "c", F.transform("all", lambda x: x["least"]).alias("firsts"))


def repeats(rows: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """(id, th, gone): of each text of `rows` (id long, text, th: its hash; none null) that has any, the first words of its repeated windows.

    Rows of equal id and text are one. A window that only its own document or later ones have is not repeated.
    """
    found = _anchored(rows, window)
    shared = settle(found.groupBy("a").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("a"))
    met = settle(found.join(_side(shared), "a"))
    own = settle(met.groupBy("a", "c").agg(F.min(F.struct("id", "th", "s", "r")).alias("x")).select("a", "c", "x.*"))
    several = settle(own.groupBy("a").agg(F.count("*").alias("stretches")).where("stretches > 1"))
    alone = own.join(_side(several), "a", "left_anti").select("a", "c", F.array_repeat("id", F.col("r")).alias("firsts"))  # no other stretch to be found in
    rest = own.join(_side(several), "a")
    firsts = alone.unionByName(_by_automata(rows, rest.where(F.col("stretches") <= crowd), window))
    if several.where(F.col("stretches") > crowd).limit(1).count():
        firsts = firsts.unionByName(_by_windows(rows, rest.where(F.col("stretches") > crowd), window))
    gone = F.filter(F.transform("firsts", lambda f, j: F.when(f < F.col("id"), F.col("s") + j)), lambda x: x.isNotNull())
    gone = met.join(firsts, ["a", "c"]).select("id", "th", gone.alias("gone")).where("size(gone) > 0")
    return gone.groupBy("id", "th").agg(F.flatten(F.collect_set("gone")).alias("gone"))  # a set, as equal rows come to the same


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """`df` with kept (the words that stay, joined by one space), n_words, n_removed and removed (spans of words: start, end).

    Words (runs of characters other than ASCII white space) of whole texts, as they are. A word goes if a window of `window` words over
    it also starts in a document with a smaller id, judged on the input; removed spans are maximal. Null texts have no words; in rows
    without an id nothing goes, nor do they take from others. Rows of equal id don't take from each other, repeated rows fare alike.
    Texts shorter than a window stay, very long ones are cut into stretches like others. Input columns named as a result are replaced;
    an empty table gives an empty one. `window` is over 16 words; `crowd` chooses a way, not a result.
    """
    hash_, gone = fresh("hash"), fresh("gone")
    known = quoted(doc_id).isNotNull() & quoted(text).isNotNull()
    rows = df.where(known).withColumn(hash_, F.xxhash64(quoted(text).cast("string")))
    found = settle(repeats(rows.select(quoted(doc_id).cast("long").alias("id"), quoted(text).cast("string").alias("text"), F.col(hash_).alias("th")), window, crowd))
    found = found.select(F.col("id").alias(other := fresh("id")), F.col("th").alias(th := fresh("th")), F.col("gone").alias(gone))
    same = (quoted(doc_id).cast("long") == F.col(other)) & (F.col(hash_) == F.col(th))
    if found.count() <= FEW:  # texts from which nothing goes don't move
        keys = F.broadcast(found.select(other, th))
        joined = rows.join(keys, same, "left_semi").join(found.hint("merge"), same).unionByName(rows.join(keys, same, "left_anti"), allowMissingColumns=True)
    else:
        joined = rows.join(found, same, "left")
    joined = joined.drop(other, th, hash_)
    rest = df.where(~known | F.isnull(known)).withColumn(gone, F.lit(None).cast("array<int>"))

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts in batches:
            out = []
            for t, at in zip(texts, starts):
                words, spans = (t or "").encode().split(), []
                for s in np.sort(at).tolist() if at is not None else ():
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = s + window
                    else:
                        spans.append([s, s + window])
                kept, last = [], 0
                for lo, hi in spans:
                    kept += words[last:lo]
                    last = hi
                kept += words[last:]
                out.append((b" ".join(kept).decode(), len(words), len(words) - len(kept), [{"start": lo, "end": hi} for lo, hi in spans]))
            yield pd.DataFrame(out, columns=["kept", "n_words", "n_removed", "removed"])

    result = F.pandas_udf(cut, "kept string, n_words long, n_removed long, removed array<struct<start: int, end: int>>")
    whole = joined.unionByName(rest)
    return with_results(whole, result(quoted(text).cast("string"), F.col(gone)), ["kept", "n_words", "n_removed", "removed"]).drop(gone)
