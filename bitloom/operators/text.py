"""Text locators and forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode's composed form, which Spark has no function for; ASCII texts pass as they are."""
    for texts in batches:
        yield texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def line(text: Column, number: Column | int) -> Column:
    """The zero-based line; null beyond the last."""
    return F.get(F.split(text, "\n"), F.lit(number) if isinstance(number, int) else number)


def byte_range(text: Column, start: int, end: int) -> Column:
    """Bytes start to end of the UTF-8 text."""
    return F.substring(F.encode(text, "UTF-8"), start + 1, end - start)


def decoded(raw: Column) -> Column:
    """The text that bytes are; null where they aren't whole UTF-8 characters."""
    return F.try_validate_utf8(raw)


def canonical(document: Column) -> Column:
    """A JSON document with the keys of every object in order, however deep, and numbers in one form; null for text that is no JSON.

    An object that has a key twice is no JSON here. Equal documents, in any order of keys, are equal texts. By Spark's VARIANT, which
    keeps an object's members sorted by name.
    """
    return F.to_json(F.try_parse_json(document))


def json_pointer(document: Column, pointer: str) -> Column:
    """The value that an RFC 6901 pointer leads to, as text (objects and arrays as `canonical`); null where it leads nowhere.

    A step of digits is an index of an array or else the name of a member. Names may have one kind of quote, not both.
    """
    if pointer and pointer[0] != "/":
        raise ValueError(f"a pointer begins with /: {pointer}")
    steps = [s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/")[1:]]
    paths = ["$"]
    for s in steps:  # every reading of digits; a document has one of them
        if "'" in s and '"' in s:
            raise ValueError(f"a name with both quotes: {pointer}")
        name = f'["{s}"]' if "'" in s else f"['{s}']"
        paths = [p + x for p in paths for x in ([f"[{s}]"] if s == "0" or s.isdigit() and s[0] != "0" else []) + [name]]
    value = F.try_parse_json(document)
    return F.coalesce(*(F.try_variant_get(value, p, "string") for p in paths))
