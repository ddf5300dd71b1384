"""Operator 5, language identification of mixed texts: scripts narrow the candidates, Viterbi labels the words.

A word's score in a language is the sum of the log-probabilities of its byte trigrams, edges included. The labels of a text's words
maximise the sum of scores less a penalty for each change of language between neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, with_results

BITS = 16
SMOOTH = 0.5
SWITCH = 12.0
#: A language has a script if so large a share of its words is in it.
SHARE = 0.02
#: First and last code points of scripts beyond the Latin ones.
SCRIPTS = (
    (0x370, 0x3FF), (0x400, 0x52F), (0x530, 0x58F), (0x590, 0x5FF), (0x600, 0x77F), (0x900, 0x97F), (0x980, 0x9FF), (0xA00, 0xA7F),
    (0xB80, 0xBFF), (0xC00, 0xC7F), (0xE00, 0xE7F), (0x10A0, 0x10FF), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF),
)
_APART = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def script(word: bytes) -> int:
    """0: Latin; k: the k-th of SCRIPTS, by the word's first letter of one; -1: letters of none."""
    latin = False
    for c in word.decode("utf-8", "ignore"):
        o = ord(c)
        for k, (first, last) in enumerate(SCRIPTS):
            if first <= o <= last:
                return k + 1
        latin |= c.isalpha() and (o < 0x250 or 0x1E00 <= o <= 0x1EFF)
    return 0 if latin else -1


class Words:
    """The words of some texts, as spans of one byte array."""

    def __init__(self, texts: pd.Series):
        own = [(t or "").lower().encode().translate(_APART) for t in texts]
        data = np.frombuffer(b" " + b"  ".join(own) + b"  ", np.uint8)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        begins = np.concatenate(([0], np.cumsum(sizes + 2)))[: len(own)] + 1
        inside = data != 32
        edge = np.diff(inside.astype(np.int8))
        self.start = np.flatnonzero(edge == 1) + 1
        self.stop = np.flatnonzero(edge == -1) + 1
        at = np.flatnonzero(inside)
        wide = data.astype(np.uint32)
        mixed = (wide[at - 1] << np.uint32(16)) | (wide[at] << np.uint32(8)) | wide[at + 1]
        self.gram = ((mixed * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
        self.row = np.searchsorted(begins, self.start, "right") - 1
        self.length = self.stop - self.start
        self.first = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.script = np.zeros(len(self.start), np.int8)
        far = np.flatnonzero(np.maximum.reduceat(data, np.stack([self.start, self.stop], 1).ravel())[::2] >= 0xCB) if len(self.start) else []
        raw = data.tobytes()
        for k in far:
            self.script[k] = script(raw[self.start[k] : self.stop[k]])
        self.cuts = np.searchsorted(self.row, np.arange(len(own) + 1))

    def sums(self, table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[self.gram], self.first) if len(self.first) else np.zeros(0, table.dtype)


@dataclass
class Model:
    """langs, log-probabilities (language x hashed trigram) and which scripts each language has (language x script)."""

    langs: list[str]
    logs: np.ndarray
    has: np.ndarray


def viterbi(scores: np.ndarray, cuts: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word; words cuts[i] to cuts[i+1] form text i. Ties stay with the same label, then the least.

    All texts advance together, a word a step; those that have ended drop out.
    """
    kind = np.min_scalar_type(-max(1, scores.shape[1]))  # signed, and wide enough for all labels
    labels = np.zeros(len(scores), kind)
    sizes = np.diff(cuts)
    order = np.argsort(-sizes, kind="stable")
    sizes, begin = sizes[order], cuts[:-1][order]
    steps = int(sizes[0]) if len(sizes) else 0
    if not steps:
        return labels
    active = np.searchsorted(-sizes, -np.arange(steps), "left")
    back = np.zeros(scores.shape, kind)
    same = np.arange(scores.shape[1], dtype=kind)
    best = scores[begin[: active[0]]].copy()
    for t in range(1, steps):
        own = best[: active[t]]
        top = own.argmax(axis=1)
        over = own[np.arange(len(own)), top][:, None] - switch
        stay = own >= over
        at = begin[: active[t]] + t
        back[at] = np.where(stay, same, top[:, None])
        best[: active[t]] = np.where(stay, own, over) + scores[at]
    state = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        at = begin[: active[t]] + t
        labels[at] = state[: active[t]]
        if t:
            state[: active[t]] = back[at, state[: active[t]]]
    return labels


def label(texts: pd.Series, model: Model, switch: float) -> pd.DataFrame:
    parts = []
    none = [("und", 0.0, [])]
    for some in blocks(texts):
        if not model.langs:
            parts += none * len(some)
            continue
        words = Words(some)
        scores = np.stack([words.sums(x) for x in model.logs], 1).astype(np.float64)
        allowed = np.concatenate([model.has, np.ones((len(model.langs), 1), bool)], 1)[:, words.script].T  # script -1: the last column
        allowed |= ~allowed.any(axis=1, keepdims=True)
        scores[~allowed] -= 1e4
        labels = viterbi(scores, words.cuts, switch)
        mass = np.zeros((len(some), len(model.langs)))
        np.add.at(mass, (words.row, labels), words.length)
        total = mass.sum(axis=1)
        pred = mass.argmax(axis=1)
        change = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (words.row[1:] != words.row[:-1])))) if len(labels) else np.zeros(0, int)
        ends = np.append(change[1:], len(labels))
        spans: list[list] = [[] for _ in some]
        for a, b in zip(change.tolist(), ends.tolist()):
            r = words.row[a]
            spans[r].append({"lang": model.langs[labels[a]], "first_word": int(a - words.cuts[r]), "n_words": b - a})
        for i, t in enumerate(some):
            if total[i] and any(map(str.isalpha, t)):
                parts.append((model.langs[pred[i]], float(mass[i, pred[i]] / total[i]), spans[i]))
            else:
                parts += none
    return pd.DataFrame(parts, columns=["lang_pred", "score", "spans"])


def fit(df: DataFrame, train: Column, lang: str = "lang", text: str = "text") -> Model:
    """A model from all rows of `df` where `train` is true and text and language are not null.

    Each task sums its rows' trigrams by language (a dense count at most of languages x 2**BITS); Spark sums the tasks' counts. The
    driver gets one row for each language and hashed trigram or script, not the texts. No such row: a model that labels all `und`.
    """
    rows = df.where(train & df[f"`{lang}`"].isNotNull() & df[f"`{text}`"].isNotNull()).select(df[f"`{lang}`"].cast("string").alias("lang"), df[f"`{text}`"].cast("string").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, own in batch.groupby("lang", sort=False):
                total = grams.setdefault(name, np.zeros((1 << BITS) + len(SCRIPTS) + 1, np.int64))
                for some in blocks(own["text"]):
                    words = Words(some)
                    total[: 1 << BITS] += np.bincount(words.gram, minlength=1 << BITS)
                    total[1 << BITS :] += np.bincount(words.script[words.script >= 0], minlength=len(SCRIPTS) + 1)
        for name, total in grams.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": name, "at": used, "n": total[used]})

    got = rows.mapInPandas(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((len(langs), (1 << BITS) + len(SCRIPTS) + 1))
    np.add.at(counts, (np.searchsorted(langs, got["lang"].to_numpy(str)) if langs else [], got["at"].to_numpy(np.int64)), got["n"].to_numpy(float))
    grams, scripts = counts[:, : 1 << BITS], counts[:, 1 << BITS :]
    logs = np.log((grams + SMOOTH) / (grams.sum(axis=1, keepdims=True) + SMOOTH * (1 << BITS)))
    return Model(langs, logs.astype(np.float32), scripts >= SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True)))


FIELDS = ["lang_pred", "score", "spans"]


def identify(df: DataFrame, model: Model, text: str = "text", switch: float = SWITCH, with_spans: bool = True) -> DataFrame:
    """`df` with `lang_pred`, `score` (the share of the word characters in its spans) and `spans` (language, first word, words).

    A map over rows with the model broadcast; only the text is read. Null text, or one without a letter: `und`, 0, no spans. Words in a
    script that no learnt language has take any. Input columns named as a result are replaced; repeated rows get equal results; very long
    texts are read whole; an empty table gives an empty one.
    """
    common = df.sparkSession.sparkContext.broadcast(model)
    fields = FIELDS if with_spans else FIELDS[:-1]
    schema = "lang_pred string, score double" + ", spans array<struct<lang: string, first_word: int, n_words: int>>" * with_spans

    @F.pandas_udf(schema)
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield label(texts, common.value, switch)[fields]

    return with_results(df, labelled(df[f"`{text}`"].cast("string")), fields)
