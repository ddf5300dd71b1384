import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from bitloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, Best_Score int"


def library(vocabulary):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def texts(parts, n, longest=60):
    rng = random.Random(3)
    return ["", " ", "  ", " a", "a ", "▁"] + ["".join(rng.choices(parts, k=rng.randint(0, longest))) for _ in range(n)]


def test_counts_equal_the_library():
    v = pieces.vocabulary(PATH)
    counter, t = pieces.Counter(v), library(v)
    for x in texts(["a", "the", "日", "\U0001f600", "x", "▁", " ", "\n", "<0x41>", "é", "ing", "Ж"], 1500):
        assert counter.text(x)[1] == len(t.encode(x, add_special_tokens=False).ids)


@pytest.mark.parametrize("scores", [(-1, -1, -1, -2, -2, -3), (-1, -2, -1, -3, -3, -4), (-2, -2, -2, -2, -2, -2)])
def test_ties_go_as_in_the_library(scores):
    v = [(pieces.UNKNOWN, 0.0)] + [(f"<0x{i:02X}>", pieces.BYTE_SCORE) for i in range(256)] + [(p, float(s)) for p, s in zip(["▁", "a", "b", "ab", "ba", "aba"], scores)]
    counter, t = pieces.Counter(v), library(v)
    for x in texts(["a", "b", "ab", " ", "c", "ä"], 800, 20):
        assert counter.text(x)[1] == len(t.encode(x, add_special_tokens=False).ids)


def test_rows(spark, sf):
    from bitloom.llm.queries import QUERIES

    rows = [(1, None, 1), (2, "", 1), (None, "two words", None), (3, "a b", 2), (3, "a b", 2), (4, "very " * 50_000, None), (5, "x" * 50_000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pieces.count_tokens(df, PATH)
    assert got.columns == ["doc_id", "text", "n_tokens", "best_score"]
    got = got.collect()
    assert [r.n_tokens for r in got[:2]] == [0, 0] and got[3] == got[4] and got[5].n_tokens >= 50_000
    assert pieces.count_tokens(df.limit(0), PATH).count() == 0
    t = library(pieces.vocabulary(PATH))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op3_token_counts"](spark, sf).collect():
        assert r.n_tokens == len(t.encode(docs[r.doc_id], add_special_tokens=False).ids)
