import numpy as np
import pytest

from bitloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, Weight int"


def plain_wanted(have, share, total):
    """Fills targets up to what there is, by bisection of the level."""
    low, high = 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        if np.minimum(have, level * share).sum() < total:
            low = level
        else:
            high = level
    return np.minimum(have, high * share)


def plain_rake(t, budget, rounds=400):
    """t: tokens by (source, lang, topic) as an array; probabilities, and the tokens wanted of each margin."""
    factor = np.full(t.shape, budget)
    wants = []
    for axis, d in enumerate(mixing.DIMENSIONS):
        have = t.sum(axis=tuple(i for i in range(3) if i != axis))
        wants.append(plain_wanted(have, have ** mixing.TEMPERATURES[d], budget * t.sum()))
    for _ in range(rounds):
        for axis in range(3):
            other = tuple(i for i in range(3) if i != axis)
            total, full = (t * np.minimum(1, factor)).sum(axis=other), (t * (factor >= 1)).sum(axis=other)
            f = np.where((wants[axis] > total) & (total - full > 1e-9 * total), (wants[axis] - full) / np.maximum(total - full, 1e-300), wants[axis] / total)
            factor = np.minimum(1e6, factor * f.reshape([-1 if i == axis else 1 for i in range(3)]))
    return np.minimum(1, factor), wants


def cells_of(spark, t):
    return spark.createDataFrame([(f"={i}", f"={j}", f"={k}", int(t[i, j, k])) for i, j, k in np.ndindex(t.shape)], "source string, lang string, topic string, t long")


@pytest.mark.parametrize("few", [0, 50_000])
@pytest.mark.parametrize("budget", [0.1, 0.3, 0.5])
def test_expected_tokens_meet_margins_and_equal_plain_raking(spark, monkeypatch, few, budget):
    if not few:  # every sum is a group of its own
        monkeypatch.setattr(mixing, "STEPS", 1)
        if budget != 0.1:
            return
    rng = np.random.default_rng(4)
    t = rng.integers(1, 500, (5, 3, 2)).astype(float)
    t[0] *= 30  # a hot source: in the others, bounds bind at the greater budgets
    got = mixing.rake(cells_of(spark, t), budget, few=few).collect()
    want, wants = plain_rake(t, budget)
    for r in got:
        at = int(r.source[1:]), int(r.lang[1:]), int(r.topic[1:])
        assert 0 < r.probability <= 1 and abs(r.probability / want[at] - 1) < 2e-3 and r.gap < 1e-3
    for d, target in zip(mixing.DIMENSIONS, wants):
        for i, x in enumerate(target):
            assert abs(sum(r.t * r.probability for r in got if r[d] == f"={i}") / x - 1) < 1e-3
    assert abs(sum(r.t * r.probability for r in got) / t.sum() / budget - 1) < 1e-3
    assert abs(sum(r.t * r.weight for r in got) - 1) < 1e-9


def test_contradictory_margins_leave_a_gap(spark):
    t = np.zeros((2, 2, 1))
    t[0, 0, 0] = t[1, 1, 0] = 500  # a language is a source
    cells = cells_of(spark, t).where("t > 0")
    got = mixing.rake(cells, 0.2, targets={"source": {"0": 0.9, "1": 0.1}, "lang": {"0": 0.1, "1": 0.9}}).collect()
    assert max(r.gap for r in got) > 0.5
    got = mixing.rake(cells, 0.2, targets={"source": {"0": 0.9, "1": 0.1}, "lang": {"0": 0.9, "1": 0.1}}).collect()
    assert max(r.gap for r in got) < 1e-4


def test_query_samples_what_it_says(spark, sf):
    from bitloom.llm.queries import QUERIES

    got = QUERIES["op9_mixing"](spark, sf).toPandas()
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    texts = {r.doc_id: r.text for r in rows}
    assert len(got) == len(texts) and all(len(texts[i].encode().split()) == n for i, n in zip(got.doc_id, got.n_tokens))
    expected = got.n_tokens * got.probability
    assert abs(expected.sum() / got.n_tokens.sum() / mixing.BUDGET - 1) < 1e-2
    # each document's fate is its id's hash against its probability
    ids = spark.createDataFrame([(int(i),) for i in got.doc_id], "doc_id long")
    chances = {r.doc_id: r.c for r in ids.select("doc_id", mixing.chance(ids.doc_id).alias("c")).collect()}
    assert ((got.doc_id.map(chances) < got.probability) == got.sampled).all()
    for d in mixing.DIMENSIONS:
        have = got.groupby(d).n_tokens.sum()
        want = plain_wanted(have.to_numpy(float), have.to_numpy(float) ** mixing.TEMPERATURES[d], mixing.BUDGET * have.sum())
        if got.gap.max() < 1e-3:
            assert np.allclose(expected.groupby(got[d]).sum(), want, rtol=2e-3)


def test_odd_rows(spark):
    rows = [(1, "a b", None, "s", 1), (1, "a b", None, "s", 1), (2, None, "en", None, 1), (3, "", "null", "s", None), (None, "x " * 200_000, "en", "t", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, budget=0.5)
    assert got.columns == ["doc_id", "text", "lang", "source", "topic", "n_tokens", "weight", "probability", "gap", "sampled"]
    got = got.collect()
    assert len(got) == 5 and len({r.sampled for r in got if r.doc_id == 1}) == 1
    assert {(r.doc_id, r.n_tokens) for r in got} == {(1, 2), (2, 0), (3, 0), (None, 200_000)}
    assert mixing.mix(df.limit(0)).count() == 0


def test_working_names_leave_user_columns_alone(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", 7, "u", 8, "v")], "doc_id long, text string, lang string, source string, __t int, __source string, t int, `a``b` string")
    r = mixing.mix(df, budget=0.5).first()
    assert (r["__t"], r["__source"], r["t"], r["a`b"]) == (7, "u", 8, "v")


def test_explicit_targets(spark):
    rows = [(i, "w " * 10, "en" if i < 90 else "de", "s", 0) for i in range(100)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), targets={"lang": {"en": 0.5, "de": 0.5}}, budget=0.15).toPandas()
    expected = (got.n_tokens * got.probability).groupby(got.lang).sum()
    assert np.allclose(expected, 75, rtol=1e-3) and np.allclose((got.n_tokens * got.weight).groupby(got.lang).sum(), 0.5, rtol=1e-3)
