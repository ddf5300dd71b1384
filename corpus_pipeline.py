"""From raw documents to encoded training text: toxicity, language, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns the rows of `docs` that it keeps, with the columns of `docs`, whatever their names;
the last returns the encoded documents. An empty table passes through every stage as one, and very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import bpe, language, mixing, simhash, toxicity
from bitloom.llm.common import held_out, quoted, settle, table


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole row as one column beside those an operator reads, so that no column of `docs` clashes with a result."""
    return docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), *columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.3 or more in a classifier of the labelled rows.

    Null texts count as empty; without a labelled row nothing is rejected. Repeated rows share a fate.
    """
    weights = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return toxicity.score(_packed(docs, "text"), weights).where("predicted = 0").select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty texts too), and those of which no language has half the words' characters.

    Rows without `lang` are judged like others. Where no row has one, nothing is learnt and all are rejected. Repeated rows share a fate.
    """
    model = language.fit(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id")))
    found = language.identify(_packed(docs, "text"), model, with_spans=False)
    return found.where("lang_pred <> 'und' and score >= 0.5").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one of the least doc_id; of ties and repeated rows, one.

    Null and word-less texts are one group. A null doc_id stays only where its whole group has none.
    """
    return simhash.one_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens meet the target shares of sources, languages and topics.

    A null source or language is a value of its own; null and empty texts have no tokens and are sampled as their cell. Repeated rows share a fate.
    """
    return mixing.mix(_packed(docs, "doc_id", "source", "lang", "text")).where("sampled").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and whether they decode to its text. Null texts have no ids and decode to the empty text.

    The result has columns of its own and no others of `docs`, so none can clash.
    """
    import public_tokenizers

    found = bpe.tokens(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    same = (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("mixing", mixture),
    ("bpe", encode),
]

#: Learnt models and tokenizers are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
