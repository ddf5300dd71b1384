"""Operator 12, fill-in-middle: documents as piece tables.

A document is a list of descriptors (buffer, from, to) over two buffers that never change: its UTF-8 bytes, and the bytes of the three
sentinels. Cutting splits a descriptor in two, arranging permutes descriptors and puts the sentinels' between them, and the digest goes
from descriptor to descriptor; no text is copied until it is wanted. Restoring reads the sentinels' places off an output, which gives
descriptors over that output, and puts them in order by the inverse permutation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, with_results

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of each form, the pieces (0 prefix, 1 middle, 2 suffix) in their order of output. Each follows its own sentinel.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
_MARKS = [b"<P>", b"<M>", b"<S>"]  # by piece
TEXT, MARKS = 0, 1


class Pieces:
    """A piece table over `text`, at first with one descriptor."""

    def __init__(self, text: bytes):
        self.buffers = (memoryview(text), memoryview(b"".join(_MARKS)))
        self.rows = [(TEXT, 0, len(text))]

    def cut(self, places: list[int]) -> None:
        """Splits descriptors at ascending byte offsets of the document; a cut at an end leaves an empty descriptor."""
        for at in places:
            k, start = 0, 0
            while k < len(self.rows) - 1 and start + self.rows[k][2] - self.rows[k][1] < at:
                start += self.rows[k][2] - self.rows[k][1]
                k += 1
            while k < len(self.rows) - 1 and start + self.rows[k][2] - self.rows[k][1] == at:  # past cuts at the same place
                start = at
                k += 1
            buffer, lo, hi = self.rows[k]
            mid = lo + at - start
            self.rows[k : k + 1] = [(buffer, lo, mid), (buffer, mid, hi)]

    def arrange(self, order: tuple[int, ...]) -> None:
        """Permutes three descriptors, each behind its sentinel's."""
        self.rows = [r for k in order for r in ((MARKS, 3 * k, 3 * k + 3), self.rows[k])]

    @classmethod
    def of_output(cls, output: bytes, order: tuple[int, ...]) -> Pieces | None:
        """The table of the text that was arranged to `output`; None if the sentinels are not where that order has them."""
        table, places, at = cls(output), [], 0
        for n, k in enumerate(order):
            at = output.find(_MARKS[k], at)
            if at < 0 or n == 0 and at > 0:
                return None
            places.append(at)
            at += 3
        ends = [*places[1:], len(output)]
        rows: list[tuple[int, int, int]] = [(TEXT, 0, 0)] * 3
        for k, start, end in zip(order, places, ends):  # the inverse permutation
            rows[k] = (TEXT, start + 3, end)
        table.rows = rows
        return table

    def parts(self) -> Iterator[memoryview]:
        return (self.buffers[b][lo:hi] for b, lo, hi in self.rows)

    def digest(self) -> str:
        h = hashlib.sha256()
        for part in self.parts():
            h.update(part)
        return h.hexdigest()

    def text(self) -> str:
        return b"".join(self.parts()).decode()


def _offset(text: str, data: bytes, chars: int) -> int:
    return chars if len(text) == len(data) else len(text[:chars].encode())


def plan(doc_id: Column, text: Column, seed: int = 1, plain: int = 10, spm: int = 20) -> list[Column]:
    """n, form, prefix_chars and middle_chars, by draws from the SHA-256 of "seed:doc_id"; the last two are null in the plain form.

    `plain` and `spm` are percentages: of all documents, and of those that are arranged. A null id counts as the empty text.
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    n = F.length(text).cast("long")
    marked = text.contains(SENTINELS[0]) | text.contains(SENTINELS[1]) | text.contains(SENTINELS[2])
    form = F.when((n == 0) | marked | (h[2] % 100 >= 100 - plain), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    arranged = form != "plain"
    return [n.alias("n"), form.alias("form"), F.when(arranged, F.least(a, b)).alias("prefix_chars"), F.when(arranged, F.abs(a - b)).alias("middle_chars")]


def _arranged(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, forms, prefixes, middles in batches:
        out, digests = [], []
        for text, form, p, m in zip(texts, forms, prefixes, middles):
            data = text.encode()
            table = Pieces(data)
            if form in ORDERS:
                table.cut([_offset(text, data, int(p)), _offset(text, data, int(p + m))])
                table.arrange(ORDERS[form])
            out.append(table.text())
            digests.append(table.digest())
        yield pd.DataFrame({"output": out, "output_sha256": digests})


def _restored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for outputs, forms in batches:
        found = []
        for output, form in zip(outputs, forms):
            data = output.encode() if output is not None else None
            table = None if data is None else Pieces.of_output(data, ORDERS[form]) if form in ORDERS else Pieces(data) if form == "plain" else None
            found.append((table.text(), table.digest()) if table else (None, None))
        yield pd.DataFrame(found, columns=["restored", "restored_sha256"])


def arrange(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """`df` with n, form, prefix_chars, middle_chars, output and output_sha256 of each whole text; a map over rows.

    n code points are cut in prefix, middle and suffix at two drawn places. Form plain leaves the text as it is: empty ones, those in
    which a sentinel occurs, and a drawn share. psm: prefix, suffix, middle; spm: suffix, prefix, middle; each behind its sentinel.
    Null texts count as empty, a null id as the empty text, so that such rows share their draws. Very long texts are descriptors like
    others. Input columns named as a result are replaced, repeated rows get equal results, an empty table gives an empty one.
    """
    names = ["n", "form", "prefix_chars", "middle_chars"]
    whole = F.coalesce(quoted(text).cast("string"), F.lit(""))
    planned = with_results(df.withColumn(own := fresh("text"), whole), F.struct(*plan(quoted(doc_id), whole, seed, plain, spm)), names)
    return with_results(planned, F.pandas_udf(_arranged, "output string, output_sha256 string")(F.col(own), "form", F.coalesce("prefix_chars", F.lit(0)), F.coalesce("middle_chars", F.lit(0))), ["output", "output_sha256"]).drop(own)


def restore(df: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """`df` with `restored` and `restored_sha256`, the exact text before `arrange`, from the output and its form alone.

    An output that does not begin with its form's first sentinel, or lacks another, a null output and an unknown form give nulls. Input
    columns named as a result are replaced, repeated rows get equal results, an empty table gives an empty one.
    """
    restored = F.pandas_udf(_restored, "restored string, restored_sha256 string")
    return with_results(df, restored(quoted(output).cast("string"), quoted(form).cast("string")), ["restored", "restored_sha256"])
