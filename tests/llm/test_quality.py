import numpy as np

from bitloom.llm import quality

SCHEMA = "doc_id long, text string, kept string, N_Words int"


def plain_repeats(words, width=8):
    windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + width))
    return len(hit)


def test_repeated_words_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        words = [b"abc"[k : k + 1] for k in rng.integers(0, 2, rng.integers(0, 90))]
        assert quality.repeated_words(words) == plain_repeats(words)


def test_rules(spark):
    clean = "The quick brown fox jumps over the lazy dog again and again today.\nIt then sleeps well beside the warm fire until dawn arrives again."
    menu = clean + "\n" + "Home | About | News | Help | Jobs | Shop | Docs | Blog | Home | Sites | One | Two | Three | Four | Five | Six | Seven"
    rows = [(1, clean, "a", 1), (2, menu, "a", 1), (3, None, None, None), (4, "", None, None), (5, "word", None, None), (None, clean, None, None), (1, clean, "a", 1), (8, "ab cd. " * 100_000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = quality.clean_lines(df)
    assert got.columns == ["doc_id", "text", *quality.FIELDS]
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].kept and by[1].clean_text == clean and by[None].kept
    assert not by[2].kept and by[2].clean_text == clean and by[2].n_removed_lines == 1
    assert by[3].base_failed and by[3].n_words == 0 and by[3].clean_text == "" and not by[4].kept
    assert by[8].n_words == 200_000 and by[8].n_repeat_words == 200_000 and by[8].base_failed
    assert quality.clean_lines(df.limit(0)).count() == 0


def test_query_counts_equal_plain_ones(spark, sf):
    from bitloom.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op1_quality_rules"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        words = texts[r.doc_id].encode().split()
        assert r.n_words == len(words) and r.word_chars == sum(len(w.decode()) for w in words)
        assert r.n_symbols == sum(texts[r.doc_id].count(c) for c in "#*$%&|<>")
        lines = [x for x in texts[r.doc_id].split("\n") if x.encode().split()]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        if len(words) < 400:
            assert r.n_repeat_words == plain_repeats(words)


def test_plain_sentences_stay_and_boilerplate_goes():
    fails = lambda line: quality.line_fails(line, line.encode(), line.encode().split())
    plain = ["She baked cookies with her two sons on a rainy Sunday afternoon.", "We log in the northern forest from May to the first snow.",
             "The old - or rather ancient - house - was sold.", "He tried to sign in for the race, but the desk was closed.", "A copyright is not a patent, as the judge explained to both sides.",
             "Copyright law changed in 1976.", "You can read more books here.", "We sign in blood for freedom.", "Cookies are good.", "Cookies are good, and more cookies are better.",
             "The button said click here, but nothing happened when she pressed it again.", "Parliament debated whether the privacy policy of the ministry was lawful."]
    junk = ["Home | News | Sport | Weather", "Sign in", "We use cookies", "Copyright 2020 Some Company Ltd", "Read more", "Home » Products » Shoes", "Please enable JavaScript to use all parts of this page.", "Click here.", "Please sign in.",
            "By going on you agree to our terms of service and our privacy policy.", "Sign up now and subscribe to our letter!", "Copyright (c) the owners.", "All rights reserved by the owner of this site."]
    assert not any(map(fails, plain)) and all(map(fails, junk))
