"""Operator 10, byte-level BPE: shared chunks are encoded once, and their joins are repaired.

A text is cut where a rolling hash of its last bytes says so, hence equal passages are cut alike wherever they stand. A chunk is
encoded alone, once for a cache that the texts of a task share. Where chunks meet, the tokens after the left one's last sure boundary
and before the right one's first are taken back, and that stretch of text is encoded anew. The chunk's own tokens must end and begin at
those boundaries exactly; where they don't, or a chunk has none, the stretch grows over the chunk to the next boundary that agrees.

A boundary is sure where the kind of character changes in a way that the vocabulary's pattern always cuts at, whatever stands around:
after a letter that no letter follows, after a digit that no digit follows, and after a mark (but an apostrophe) that a letter, a digit
or white space follows. Scripts without spaces have such places at every mark of punctuation.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import quoted

#: Bytes in the rolling window, bits of its hash that must be 0 at a cut, least bytes in a chunk, and characters that a cache holds.
WINDOW_STEPS, CUT_BITS, LEAST, CACHE = 4, 8, 64, 24_000_000
#: Fixed value: the pattern of byte-level pre-tokenisers of this kind, which the tokenizer file only names.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KINDS = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])"
_FIRST, _LAST = regex.compile(_KINDS), regex.compile(f"(?r)(?:{_KINDS})")


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encodes and decodes as the tokenizer file at `path` does; a byte-level BPE whose ids follow its merges is asked for."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("the tokenizer file is not a plain byte-level BPE")
        byte = _bytes_of()
        self.bytes = {i: bytes(byte[c] for c in t) for t, i in model["vocab"].items()}
        if [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]] != list(range(256, 256 + len(model["merges"]))):
            raise ValueError("the ids don't follow the merges")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[bytes, tuple[int, list[int], int]] = {}
        self.older = self.cache  # what the cache held when it was last full
        self.cached = self.hits = 0
        self.read = self.encoded = 0  # bytes of texts, and bytes given to the encoder

    def cuts(self, data: bytes) -> list[int]:
        """The chunks' ends."""
        if len(data) <= LEAST:
            return [len(data)]
        b = np.frombuffer(data, np.uint8)
        h, factor, step = b.astype(np.uint32) + np.uint32(1), np.uint32(0x9E3779B1), 1
        for _ in range(WINDOW_STEPS):  # windows of 2, 4, 8 and 16 bytes
            h[step:] = h[step:] + h[:-step] * factor
            factor, step = np.uint32(int(factor) ** 2 & 0xFFFFFFFF), 2 * step
        found = np.flatnonzero((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - CUT_BITS) == 0) + 1
        ends, last = [], 0
        for p in found[(found < len(b))].tolist():
            if p - last >= LEAST and b[p] & 0xC0 != 0x80:
                ends.append(p)
                last = p
        ends.append(len(b))
        return ends

    def anew(self, data: bytes) -> list[int]:
        self.encoded += len(data)
        return self.core.encode_ordinary(data.decode())

    def chunk(self, data: bytes) -> tuple[int, list[int], int]:
        """Of a chunk: its bytes before the first sure boundary, the ids from there to the last one, the bytes after; -1: none."""
        if known := self.cache.get(data):
            self.hits += 1
            return known
        if known := self.older.get(data):
            self.hits += 1
            self.cache[data] = known
            self.cached += len(data)
            return known
        text = data.decode()
        ids = self.anew(data)
        out = (-1, ids, -1)
        if first := _FIRST.search(text):
            head, tail = len(text[: first.start()].encode()), len(text[_LAST.search(text).start() :].encode())
            a = b = n = m = 0
            while n < head:
                n += len(self.bytes[ids[a]])
                a += 1
            while m < tail:
                b += 1
                m += len(self.bytes[ids[-b]])
            if n == head and m == tail:  # the tokens agree with the boundaries
                out = (head, ids[a : len(ids) - b], tail)
        if self.cached > CACHE:
            self.cache, self.older, self.cached = {}, self.cache, 0
        self.cache[data] = out
        self.cached += len(data)
        return out

    def section(self, text: str) -> list[int]:
        """The ids of a text without special tokens."""
        data, out, open_from, start = text.encode(), [], 0, 0
        self.read += len(data)
        for end in self.cuts(data):
            head, ids, tail = self.chunk(data[start:end])
            if head >= 0:
                if start + head > open_from:
                    out += self.anew(data[open_from : start + head])
                out += ids
                open_from = end - tail
            start = end
        if open_from < len(data):
            out += self.anew(data[open_from:])
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.parts or not any(s in text for s in self.special):
            return self.section(text)
        out: list[int] = []
        for part in self.parts.split(text):
            out += [self.special[part]] if part in self.special else self.section(part) if part else []
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def tokens(df: DataFrame, path: str, text: str = "text", decode: bool = True, rows: int = 256) -> DataFrame:
    """`df` with `ids` (array<int>), those of each whole text, and `decoded`, the text that the ids give back.

    A map over rows; each task loads the tokenizer file at `path`, which its machine must have, and keeps a bounded cache of chunks.
    Null and empty texts: no ids, decoded "". Very long texts are encoded whole, chunk by chunk. Special tokens' strings in a text
    become their ids, as the library has it by default. Input columns named as a result are replaced; repeated rows get equal results;
    an empty table gives an empty one. Results leave in batches of `rows`.
    """
    names = ["ids"] + ["decoded"] * decode
    df = df.select(*(quoted(c) for c in df.columns if c.lower() not in names))
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                ids = [codec.encode(t) for t in batch.column(at).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.fromiter((i for own in ids for i in own), np.int32, int(ends[-1]))
                new = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decode:
                    new.append(pa.array([codec.decode(own) for own in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
