"""Operator 1, quality rules: lines first, then documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, with_results

#: Characters that count as symbols, separators of menus, and marks that may end a line.
SYMBOLS = b"#*$%&|<>"
BARS = ("|", "»", "›", "•", "·", "::", "-", "/")
TERMINALS = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", ")", "。", "！", "？")
#: What boilerplate alone says, in lower case; and hints at it, which plain sentences hold as well.
BOILERPLATE = r"all rights reserved|licensed under|released under the|enable javascript|©|lorem ipsum|skip to content|copyright (?:[0-9]{4}|\(c\))"
HINTS = "privacy policy|cookie policy|terms of use|terms of service|click here|cookies|copyright|subscribe to|sign in|sign up|log in|read more|share this"
#: Words of a line that may be boilerplate, and of one that a single hint makes so where no final mark ends it.
LONG_LINE = 40
SHORT_LINE = 6
WINDOW = 8
_SAYS, _HINTS = re.compile(BOILERPLATE), re.compile(HINTS)
_MIX = np.random.default_rng(20261128).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)
_BARS = frozenset(x.encode() for x in BARS)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """How many words stand in windows of `width` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number = dict(zip(words, range(len(words))))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed += ids[k : k + n].astype(np.uint64) * _MIX[k % WINDOW]
    if np.unique(mixed).size == n:  # equal windows have equal sums: none repeats
        return 0
    same = np.unique(np.lib.stride_tricks.sliding_window_view(ids, width), axis=0, return_inverse=True)[1].ravel()
    twice = np.bincount(same)[same] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def line_fails(line: str, data: bytes, words: list[bytes]) -> bool:
    """Whether a line that has words breaks a rule.

    Punctuation: over 15 symbols in 100 characters of words, more than one "!" for two words, no letter, or under five words
    and no final mark. Navigation: a fifth of the words or more are separators, and no final mark. Boilerplate: up to LONG_LINE words
    with one of BOILERPLATE, with two different HINTS, or with one that is half of its words, or that stands in up to SHORT_LINE words
    without a final mark. Repetition: eight words or more, of which over a third equal the word before.
    """
    n = len(words)
    chars = len(line) - len(data) + len(data.translate(None, SPACES))
    if 100 * (len(data) - len(data.translate(None, SYMBOLS))) > 15 * chars or 2 * data.count(b"!") > n:
        return True
    if (n < 5 or 5 * sum(w in _BARS for w in words) >= n) and not words[-1].decode().endswith(TERMINALS):
        return True
    if n <= LONG_LINE:
        if _SAYS.search(low := line.lower()):
            return True
        hints = _HINTS.findall(low)
        if hints and (len(set(hints)) > 1 or 2 * sum(h.count(" ") + 1 for h in hints) >= n or n <= SHORT_LINE and not words[-1].decode().endswith(TERMINALS)):
            return True
    if n >= 8 and 3 * sum(map(eq, words, words[1:])) > n:
        return True
    return not any(map(str.isalpha, line))


def assess(text: str | None, max_loss_pct: int, min_words: int, repeat_pct: int) -> tuple:
    text = text or ""
    data = text.encode()
    words = data.split()
    chars = len(text) - len(data) + len(data.translate(None, SPACES))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    repeats = repeated_words(words)
    seen: set[str] = set()
    kept: list[str] = []
    doubles = lost = removed = 0
    for line in text.split("\n"):
        own = (raw := line.encode()).split()
        if own:
            doubles += line in seen
            seen.add(line)
            if line_fails(line, raw, own):
                lost += len(own)
                removed += 1
                continue
        kept.append(line)
    n = len(words)
    failed = n < min_words or 100 * repeats > repeat_pct * n
    return n, chars, symbols, doubles, repeats, failed, not failed and 100 * lost <= max_loss_pct * n, removed, lost, "\n".join(kept)


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words", "clean_text"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_removed_lines long, n_removed_words long, clean_text string"


def clean_lines(df: DataFrame, text: str = "text", max_loss_pct: int = 50, min_words: int = 20, repeat_pct: int = 30, with_text: bool = True) -> DataFrame:
    """`df` with the counts of each whole text, the verdict `kept`, and `clean_text`, the text without its failing lines.

    A map over rows: no shuffle, and no row depends on another. Null text counts as empty: all counts 0, base_failed true, kept
    false, clean_text "". Repeated rows get equal results. Input columns named as a result are replaced. An empty table gives an
    empty one, and very long texts are read whole. with_text=False leaves clean_text null, which spares its transfer.
    """

    @F.pandas_udf(SCHEMA)
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame([assess(t, max_loss_pct, min_words, repeat_pct) for t in texts], columns=FIELDS)
            yield out if with_text else out.assign(clean_text=None)

    return with_results(df, rules(_text(df, text)), FIELDS if with_text else FIELDS[:-1])


def _text(df: DataFrame, text: str) -> Column:
    return df[f"`{text}`"].cast("string")
