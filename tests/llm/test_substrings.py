import random

import numpy as np
import pytest

from bitloom.llm import substrings

SCHEMA = "doc_id long, text string, KEPT int"


def brute(rows, window):
    """rows: (id, text) to (kept, n_words, n_removed, spans), by a table of all windows."""
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - window + 1):
            if doc is not None:
                w = tuple(words[k : k + window])
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = np.zeros(len(words) + 1, bool)
        spans = []
        for k in range(len(words) - window + 1):
            if doc is not None and first[tuple(words[k : k + window])] < doc:
                gone[k : k + window] = True
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + window
                else:
                    spans.append([k, k + window])
        kept = b" ".join(w for w, g in zip(words, gone) if not g).decode()
        out.append((doc, text, kept, len(words), int(gone.sum()), tuple(map(tuple, spans))))
    return out


def made(seed, window):
    """Texts with shared passages, near copies, periods and odd rows."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c", "d", "é", "日本", "\x1c", "x\xa0y"]) * rng.randint(1, 2)
    many = lambda n: [word() for _ in range(n)]
    passages = [many(rng.randint(window - 3, window + 40)) for _ in range(6)]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice([lambda: many(rng.randint(0, 30)), lambda: rng.choice(passages), lambda: (many(3) * 40)[: rng.randint(0, 90)], lambda: ["ha"] * rng.randint(0, 130)])()
        texts.append(words)
    for _ in range(50):  # near copies
        words = list(rng.choice(texts))
        for _ in range(rng.randint(0, 3)):
            if words:
                words[rng.randrange(len(words))] = word()
        texts.append(words)
    rows = [(rng.randint(0, 400) - 50, rng.choice([" ", "\n", " \t"]).join(t)) for t in texts]
    rows += [(None, " ".join(passages[0])), (-999, None), (7, ""), (8, "  \n "), *rows[:9], (None, None), (3, " ".join(many(3000) + passages[1] * 30))]
    rng.shuffle(rows)
    return rows


def plainly(df):
    return sorted(((r.doc_id, r.text, r.kept, r.n_words, r.n_removed, tuple((x.start, x.end) for x in r.removed)) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, window, crowd", [(1, 50, 1000), (2, 50, 3), (3, 20, 1000), (4, 17, 1), (5, 33, 8)])
def test_against_all_windows(spark, seed, window, crowd):
    rows = made(seed, window)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(5)
    got = substrings.remove_repeats(df, window=window, crowd=crowd)
    assert got.columns == ["doc_id", "text", "kept", "n_words", "n_removed", "removed"]
    assert plainly(got) == sorted(brute(rows, window), key=str)


def test_a_passage_with_other_surroundings_each_time(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, " ".join(str(rng.random()) for _ in range(30)) + " " + passage + " " + " ".join(str(rng.random()) for _ in range(30))) for k in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = plainly(substrings.remove_repeats(df, crowd=50))
    assert got == sorted(brute(rows, 50), key=str)
    assert {r[4] for r in got} == {0, 60}


def test_first_documents_in_an_automaton():
    rng = random.Random(2)
    for _ in range(200):
        texts = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(1, 6))]
        own = substrings.Automaton()
        for doc, words in enumerate(texts):
            own.add(words, doc)
        for words in [*texts, [rng.choice([b"a", b"b", b"c"]) for _ in range(12)]]:
            want = [next((d for d, t in enumerate(texts) if any(t[k : k + 3] == words[i : i + 3] for k in range(len(t) - 2))), None) for i in range(len(words) - 2)]
            assert own.firsts(words, 3) == want


def test_stretches_hold_every_window_once():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcde") for _ in range(n)).encode() for n in (0, 49, 50, 51, 400, 7, 1000)]
    row, start, count, anchor, content = substrings.stretches(texts)
    for k, t in enumerate(texts):
        own = np.concatenate([np.arange(s, s + n) for s, n in zip(start[row == k], count[row == k])] or [np.zeros(0, int)])
        assert own.tolist() == list(range(max(0, len(t.split()) - 49)))
    assert count.max() <= substrings.WINDOW - substrings.GRAM + 1
    again = substrings.stretches([b"x y z " + texts[4], texts[4] + b" x"])
    inner = set(zip(anchor[row == 4].tolist(), content[row == 4].tolist()))
    assert len(inner & set(zip(again[3].tolist(), again[4].tolist()))) >= len(inner) - 2


def test_an_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
