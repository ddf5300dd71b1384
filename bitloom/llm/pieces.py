"""Operator 3, token counts of a unigram vocabulary without its tokens: Aho-Corasick matches, then a count-only Viterbi.

A word's best segmentation is found from left to right: every position holds the best score that reaches it and the number of pieces
on that path. No path is kept. Rules on ties are those of the tokenizers library's Unigram model: of equal scores the piece that
starts first stands, and a character that is no piece costs the least score less 10 and counts as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_results

SPACE = "▁"
#: Words whose results a task keeps at once, and the longest of them.
CACHE, LONGEST = 400_000, 64
#: What the library takes off the least score for an unknown character; the name of that, which no word can hold; the score of byte pieces.
PENALTY, UNKNOWN, BYTE_SCORE = 10.0, "<unk>▁", -1000.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id, from a sentencepiece file: the k-th normal piece has score -ln(1 + k), so that ranks act as frequencies."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = [(UNKNOWN, 0.0)]
    rank = 0
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append((piece, BYTE_SCORE))
        elif not (model.is_control(i) or model.is_unknown(i) or SPACE in piece[1:]):
            rank += 1
            out.append((piece, -math.log(1 + rank)))
    return out


class Counter:
    """Counts the pieces of texts; spaces begin words, as the Metaspace pre-tokenizer has it."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.cache: dict[str, tuple[float, int]] = {}

    def word(self, word: str) -> tuple[float, int]:
        """(score, pieces) of the best segmentation."""
        best: list[float | None] = [0.0] + [None] * len(word)
        count = [0] * (len(word) + 1)
        reached = 0  # positions up to here are final
        single = False

        def close(end: int) -> None:
            nonlocal reached, single
            while reached < end:  # a position that no match of one character ends at can be reached by an unknown one
                score = best[reached] + self.unknown
                if not single and (best[reached + 1] is None or score > best[reached + 1]):
                    best[reached + 1] = score
                    count[reached + 1] = count[reached] + len(word[reached].encode())
                reached += 1
                single = False

        for last, (length, score) in self.automaton.iter(word):  # by end, the longest first: starts ascend
            close(last)
            end, start = last + 1, last + 1 - length
            single |= length == 1
            score += best[start]
            if best[end] is None or score > best[end]:
                best[end], count[end] = score, count[start] + 1
        close(len(word))
        return best[-1], count[-1]

    def text(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            del words[0]  # a text that begins with a space gets no other
        score, count, cache = 0.0, 0, self.cache
        for w in words:
            if (got := cache.get(w)) is None:
                got = self.word(SPACE + w)
                if len(w) <= LONGEST:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[w] = got
            score += got[0]
            count += got[1]
        return score, count


def count_tokens(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`df` with `n_tokens` and `best_score`, the pieces and the score of each whole text's best segmentation.

    A map over rows. Null and empty texts: 0 and 0. Input columns named as a result are replaced; repeated rows get equal results,
    very long texts are read whole, an empty table gives an empty one. `path` is the vocabulary file, which each machine must have.
    """

    @F.pandas_udf("n_tokens long, best_score double")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(vocabulary(path))
        for texts in batches:
            got = [counter.text(t) for t in texts]
            yield pd.DataFrame({"n_tokens": [n for _, n in got], "best_score": [s for s, _ in got]})

    return with_results(df, counted(df[f"`{text}`"].cast("string")), ["n_tokens", "best_score"])
