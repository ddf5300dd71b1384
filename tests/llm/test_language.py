import itertools

import numpy as np
from pyspark.sql import functions as F

from bitloom.llm import language
from bitloom.llm.common import held_out

SCHEMA = "doc_id long, text string, lang string, SCORE string"


def test_viterbi_equals_all_labelings():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(0, 6, 4)
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        scores = rng.normal(size=(cuts[-1], 3)) * 4
        got = language.viterbi(scores, cuts, 2.0)
        value = lambda path, s: sum(s[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
        for a, b in zip(cuts, cuts[1:]):
            best = max(value(p, scores[a:b]) for p in itertools.product(range(3), repeat=int(b - a)))
            assert abs(value(got[a:b].tolist(), scores[a:b]) - best) < 1e-9


def test_held_out_accuracy(spark, sf):
    from bitloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op5_language_id"](spark, sf).join(docs, "doc_id").where("held_out").toPandas()
    assert len(got) and (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_spans_scripts_and_odd_rows(spark):
    en, ru = "the river flows over the old stones and under the bridge", "река течёт под старым мостом и над камнями города"
    train = [(i, t, g, None) for i in range(8) for t, g in ((en, "en"), (ru, "ru"), (None, "en"), (ru, None))]
    df = spark.createDataFrame(train, SCHEMA)
    model = language.fit(df, F.lit(True))
    assert model.langs == ["en", "ru"] and model.has.sum() == 2
    rows = [(1, en + ". " + ru + ".", "xx", "z"), (2, None, None, None), (3, "12 -- 7", "en", None), (4, "", None, None), (None, ru, None, None), (4, en * 3000, "ru", None)]
    got = language.identify(spark.createDataFrame(rows, SCHEMA), model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "spans"]
    got = got.collect()
    assert [s.lang for s in got[0].spans] == ["en", "ru"] and [s.n_words for s in got[0].spans] == [11, 9]
    assert [r.lang_pred for r in got[1:]] == ["und", "und", "und", "ru", "en"]
    assert [r.score for r in got[1:4]] == [0, 0, 0]
    none = language.fit(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_fold(spark):
    import zlib

    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_viterbi_tells_200_labels_apart():
    scores = np.zeros((40, 200))
    want = np.repeat([199, 128, 127, 5], 10)
    scores[np.arange(40), want] = 9.0
    assert language.viterbi(scores, np.array([0, 15, 40]), 2.0).tolist() == want.tolist()
