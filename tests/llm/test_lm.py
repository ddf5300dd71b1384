import random
from collections import Counter

import numpy as np
import pytest

from bitloom.llm import lm

SCHEMA = "doc_id long, text string, N_words string"


def counts_of(tokens, size):
    return np.maximum(1, np.bincount(tokens, minlength=size)) * (np.arange(size) > 0)


def test_probabilities_of_a_place_sum_to_one():
    rng = np.random.default_rng(0)
    net = lm.Network(np.concatenate(([0], rng.integers(1, 50, 29))), classes=5)
    net.table[:] = rng.normal(size=net.table.shape)
    tokens = np.array([0, 0, 5, 7, 9, 3, 0, 0])
    total = 0.0
    for t in range(1, 30):
        tokens[4] = t
        total += np.exp(net.log_probabilities(tokens, np.array([4]))[0])
    assert abs(total - 1) < 1e-5


def test_spellings_of_a_bucket_sum_to_one():
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 9))).encode() for _ in range(300)})
    first, pair, ending, bucket = lm.spelling(words)
    assert [x.tolist() for x in (pair, ending)] == [[(w[i - 1] if i else 256) * 256 + w[i] for w in words for i in range(len(w))], [(w[-2] if len(w) > 1 else 256) * 256 + w[-1] for w in words]]
    endings = np.bincount(ending, minlength=lm._PAIRS)
    s = lm.Spellings.of(np.bincount(bucket, minlength=lm.BUCKETS), endings, np.bincount(pair, minlength=lm._PAIRS) - endings)
    shares = np.exp(s.ending)
    assert np.allclose(np.bincount(lm.bucket_of(np.arange(lm._PAIRS)), shares), 1)  # of a bucket over its endings
    assert np.allclose(np.exp(s.before).reshape(257, 256).sum(axis=0), 1)  # of what stands before a byte
    bucket, logs = s.logs([b"abba", b"b"])
    at = lambda a, b: a * 256 + b
    assert np.isclose(logs[0], s.ending[at(98, 97)] + s.before[at(98, 98)] + s.before[at(97, 98)] + s.before[at(256, 97)]) and np.isclose(logs[1], s.ending[at(256, 98)])


def test_training_raises_the_likelihood_from_both_sides():
    rng = np.random.default_rng(1)
    left, right = rng.integers(1, 9, 4000), rng.integers(1, 9, 4000)
    mid = 9 + (left + right) % 5  # neither side alone tells it
    tokens = np.concatenate([[0, 0], np.stack([left, mid, right, np.zeros(4000, int), np.zeros(4000, int)], 1).ravel(), [0, 0]])
    net, at = lm.Network(counts_of(tokens, 20), classes=4), np.flatnonzero(tokens >= 9)
    memory = np.zeros_like(net.table)
    before = net.log_probabilities(tokens, at).mean()
    for _ in range(60):
        net.train(tokens, at, memory)
    assert net.log_probabilities(tokens, at).mean() > before + 0.5


def test_gradient_equals_differences(monkeypatch):
    monkeypatch.setattr(lm, "RATE", 1e-3)
    rng = np.random.default_rng(2)
    tokens = np.concatenate([[0, 0], rng.integers(1, 12, 40), [0, 0]])
    at = np.flatnonzero(tokens)
    net = lm.Network(counts_of(tokens, 12), classes=3)
    net.table = net.table.astype(np.float64) + rng.normal(0, 0.2, net.table.shape)
    net = lm.Network(net.counts, net.table, classes=3)
    start, memory = net.table.copy(), np.zeros_like(net.table)
    net.train(tokens, at, memory)
    moved = net.table - start
    for i, j in [(3, 2), (15, 4), (len(net.inputs), 1), (len(net.inputs) + 1, lm.DIM), (len(net.inputs) + net.classes + 4, 3)]:
        ends = []
        for e in (1e-5, -1e-5):
            table = start.copy()
            table[i, j] += e
            ends.append(lm.Network(net.counts, table, classes=3).log_probabilities(tokens, at).sum())
        slope = (ends[0] - ends[1]) / 2e-5
        assert np.sign(moved[i, j]) == np.sign(slope) and abs(abs(moved[i, j]) - 1e-3) < 1e-4 or abs(slope) < 1e-3


def plain_score(text, net, v, counts):
    """One document by plain loops, every probability from the definition."""
    words = lm.words_of(text)
    s = v.spellings
    top = [w for w, i in v.index.items() if i < lm.WORDS and v.share[i] == 0 and v.token[i] == i + 1]
    number = {w: v.token[v.index[w]] for w in top}

    def token(w):
        return int(number[w]) if w in number else 1 + len(number) + int(s.logs([w])[0][0])

    cut = [0, 0, *map(token, words), 0, 0]
    total = 0.0
    for i, w in enumerate(words):
        x = sum(net.inputs[cut[i + 2 + p] + k * net.size, : lm.DIM].astype(float) for k, p in enumerate(lm.PLACES))
        h = np.tanh(x)
        t = cut[i + 2]
        first = net.first[:, : lm.DIM].astype(float) @ h + net.first[:, lm.DIM]
        c = net.of[t]
        own = net.second[net.cuts[c] : net.cuts[c + 1]].astype(float)
        second = own[:, : lm.DIM] @ h + own[:, lm.DIM]
        total += first[c] - np.log(np.exp(first).sum()) + second[net.place[t]] - np.log(np.exp(second).sum())
        if w not in number:
            b, log = s.logs([w])
            total += np.log((counts.get(w, 0) + s.kinds[b[0]] * np.exp(log[0])) / (s.n[b[0]] + s.kinds[b[0]]))
    return len(words), total


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize("known", [0, 3000, 1 << 17])
def test_scores_equal_plain_loops(spark, table, monkeypatch, known):
    monkeypatch.setattr(lm, "KNOWN", max(known, lm.WORDS))
    tokens, v = lm.tokenized(table)
    net = lm.fit(tokens, v)
    texts = {r.doc_id: r.text for r in table.collect()}
    counts = Counter(w for t in texts.values() for w in lm.words_of(t))
    got = {r.doc_id: r for r in lm.score(tokens, net).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts)[:25]:
        n, want = plain_score(texts[i], net, v, counts)
        assert got[i].n_words == n and abs(got[i].log_likelihood - want) < 1e-3 + 1e-5 * n


def test_dealing_of_rows_does_not_matter(table, monkeypatch):
    monkeypatch.setattr(lm, "GROUP", 20_000)
    found = []
    for parts in (4, 16):
        tokens, v = lm.tokenized(table.repartition(parts))
        found.append({r.doc_id: r.mean_log_likelihood for r in lm.score(tokens, lm.fit(tokens, v)).collect()})
    assert found[0].keys() == found[1].keys()
    assert all(abs(a - found[1][i]) < 1e-4 for i, a in found[0].items() if a is not None)


def test_text_beats_random_letters_and_its_own_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id % 5 = 0").collect() if len(lm.words_of(r.text)) >= 30]
    gibberish = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=len(w))) for w in lm.words_of(t))) for i, t in rows]
    shuffled = [(i, " ".join(w.decode() for w in rng.sample(lm.words_of(t), len(lm.words_of(t))))) for i, t in rows]
    tokens, v = lm.tokenized(docs.where("doc_id % 5 <> 0"))
    net = lm.fit(tokens, v)
    a, b, c = ({r.doc_id: r.log_likelihood for r in lm.score(lm.tokenized(spark.createDataFrame(x, "doc_id long, text string"), v=v)[0], net).collect()} for x in (rows, gibberish, shuffled))
    assert np.mean([a[i] > b[i] for i in a]) >= 0.99
    assert np.mean([a[i] > c[i] for i in a]) >= 0.6  # these texts are nearly random words: order tells little


def test_odd_rows(spark):
    rows = [(1, "red car big dog " * 15, "x"), (901, None, None), (902, "  ", None), (None, "red car", None), (1, "red car big dog " * 15, "x"), (903, "red car " + " zzz " * 200_000, None), (904, "", "`")]
    tokens, v = lm.tokenized(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = lm.score(tokens, lm.fit(tokens, v))
    assert got.columns == ["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"]
    all_rows = got.collect()
    by = {r.doc_id: r for r in all_rows}
    for i in (901, 902, 904):
        assert (by[i].n_words, by[i].log_likelihood, by[i].mean_log_likelihood) == (0, 0.0, None)
    one, other = (r.log_likelihood for r in all_rows if r.doc_id == 1)
    assert abs(one - other) < 1e-5 * 60 and by[903].n_words == 200_002 and len(all_rows) == 7
    odd = spark.createDataFrame([(1, "a b", 2, 3)], "`do``c` long, text string, row long, `group` int")
    assert lm.score(lm.tokenized(odd)[0], lm.Network(v.counts)).columns[:3] == ["do`c", "row", "group"]
    none, v = lm.tokenized(spark.createDataFrame([], SCHEMA))
    assert lm.score(none, lm.fit(none, v)).count() == 0


def test_word_counts_cover_all_rows(table):
    want = sum(len(lm.words_of(r.text)) for r in table.collect())
    assert lm.word_counts(table, flush=100).groupBy().sum("n").first()[0] == want


def test_rounds_train_each_place_once():
    at = np.arange(5001)
    assert sorted(np.concatenate([at[r :: lm.ROUNDS] for r in range(lm.ROUNDS)])) == at.tolist() and lm.DIM >= 16
