import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bitloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library_on_odd_texts(library):
    rng = random.Random(1)
    parts = ["'", "s", "re", "ll", " ", "  ", "\n", "é", "1", "!", "　", "日", "a", "\t", "<|endoftext|>", "the ", "word "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 700))) for _ in range(400)] + ["", " " * 999, "a" * 3000, "don't we'll " * 300, "same passage of words here. " * 400]
    codec = bpe.Codec(PATH)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert codec.encode(text) == want.ids
        assert codec.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)
    assert codec.hits


def test_scripts_without_spaces_are_reused(library):
    rng = random.Random(2)
    sentence = lambda chars, mark: "".join(rng.choices(chars, k=rng.randint(5, 25))) + mark
    for chars, mark in (("的一是不了人我在有他这中大来上国", "。"), ("あいうえおかきくけこさしすせそ", "、"), ("abcdefgh", ";"), ("0123456789", ",")):
        passage = "".join(sentence(chars, mark) for _ in range(200))
        texts = [sentence(chars, mark) + passage + sentence(chars, mark) for _ in range(12)]
        codec = bpe.Codec(PATH)
        for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            assert codec.encode(text) == want.ids
        assert codec.encoded < 0.6 * codec.read and codec.hits


def test_texts_of_one_word_are_whole(library):
    rng = random.Random(3)
    texts = ["".join(rng.choices("的一是不了人我在有他", k=3000)), "".join(rng.choices("abcdefg", k=5000)), "'" * 500, "\n" * 700 + "x", "can't" * 300]
    codec = bpe.Codec(PATH)
    for text in texts:
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_a_full_cache_keeps_what_is_used(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3000)
    codec, rng = bpe.Codec(PATH), random.Random(4)
    line = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60)) + ". "
    common = "".join(line() for _ in range(4))
    for _ in range(30):
        codec.encode(common + line())
    assert codec.hits > 60 and codec.cached <= 3000 + len(common)


def test_rows(spark):
    rows = [(1, None, None), (2, "", "x"), (None, "two words", "y"), (3, "<|endoftext|> a", "y"), (3, "<|endoftext|> a", "y"), (4, "long text " * 40_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    got = bpe.tokens(df, PATH)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    got = got.collect()
    assert [(r.doc_id, r.decoded) for r in got] == [(a, b or "") for a, b, _ in rows]
    assert got[0].ids == [] and got[3].ids[0] == 50256 and got[3].ids == got[4].ids
    assert bpe.tokens(df.limit(0), PATH).count() == 0


def test_query_equals_the_library(spark, sf, library):
    from bitloom.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op10_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d, e in zip(docs, library.encode_batch([d.text for d in docs], add_special_tokens=False)):
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
