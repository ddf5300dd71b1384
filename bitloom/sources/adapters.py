"""Raw tables of three kinds of collections as items: (source_id, texts, labels).

Names of collections are normalised by `adapter`, which gives the function for a kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import Part, ledger, violations

#: Fixed value: what an item without a tag is called.
FALLBACK = "a generic photo"


def indexed(rows: DataFrame, tags: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows chosen by index: rows (raw_index, source_id), tags (raw_index, position, tag), labels (raw_index, label).

    Tags are in order of position; an item without one has FALLBACK. Indexes without a row are dropped.
    """
    t = tags.groupBy("raw_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "tag"))), lambda x: x["tag"]).alias("texts"))
    c = labels.groupBy("raw_index").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    out = rows.join(t, "raw_index", "left").join(c, "raw_index", "left")
    return out.select("source_id", F.coalesce("texts", F.array(F.lit(FALLBACK))).alias("texts"), F.coalesce("labels", F.array().cast("array<int>")).alias("labels"))


def captioned(images: list[DataFrame], captions: list[DataFrame], categories: list[DataFrame]) -> DataFrame:
    """Parts (as training and validation) joined: images (image_id), captions (image_id, caption_id, caption), categories (image_id, label).

    Images with a caption and a category stay; captions are in order of their ids.
    """
    every = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(every(parts[1:]))
    t = every(captions).groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("caption_id", "caption"))), lambda x: x["caption"]).alias("texts"))
    c = every(categories).groupBy("image_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return every(images).select("image_id").distinct().join(t, "image_id").join(c, "image_id").select(F.col("image_id").alias("source_id"), "texts", "labels")


def tagged(tags: DataFrame, valid: DataFrame, members: DataFrame) -> DataFrame:
    """Tags (photo_id, tag) that a dictionary `valid` (tag) has, as prompts; photos without one are dropped. members: (photo_id, label)."""
    kept = tags.join(valid.select("tag").distinct(), "tag", "left_semi")
    t = kept.groupBy("photo_id").agg(F.transform(F.sort_array(F.collect_set("tag")), lambda x: F.concat(F.lit("a photo of "), x)).alias("texts"))
    c = members.groupBy("photo_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return t.join(c, "photo_id", "left").select(F.col("photo_id").alias("source_id"), "texts", F.coalesce("labels", F.array().cast("array<int>")).alias("labels"))


_KINDS: dict[str, Callable[..., DataFrame]] = {"indexed": indexed, "captioned": captioned, "tagged": tagged}


def adapter(name: str) -> Callable[..., DataFrame]:
    """The function for a kind's name, however it is written; any other name is an error that says which there are."""
    kind = name.strip().lower().replace("-", "").replace("_", "").replace(" ", "")
    if kind not in _KINDS:
        raise ValueError(f"no kind {name!r}: there are {', '.join(sorted(_KINDS))}")
    return _KINDS[kind]


def index_faults(rows: DataFrame, tags: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule, ids, example): what `indexed` would pass over. Indexes that tags or labels have and rows don't, repeated or null ones, rows
    without a name, and tags whose positions are not 0, 1, 2..."""
    place = tags.groupBy("raw_index").agg(F.count("*").alias("n"), F.min("position").alias("low"), F.max("position").alias("high"), F.countDistinct("position").alias("kinds"))
    parts = {
        "rows": Part(rows, "raw_index", {"name": F.col("source_id").isNull()}), "labels": Part(labels, "raw_index", {"null": F.col("label").isNull()}),
        "tags": Part(place, "raw_index", {"positions": (F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("kinds") != F.col("n"))}),
    }
    return violations(ledger(parts, {"rows.repeated": "rows > 1", "tags.stray": "tags > 0 and rows = 0", "labels.stray": "labels > 0 and rows = 0"}))
