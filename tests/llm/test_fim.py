import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitloom.llm import fim

SCHEMA = "doc_id long, text string, FORM string"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<PSM>ab é\U0001f600", max_size=40), st.data())
def test_pieces_against_slices(text, data):
    if any(m in text for m in fim.SENTINELS):
        return
    a, b = sorted(data.draw(st.integers(0, len(text))) for _ in range(2))
    raw = text.encode()
    for form, want in (("psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"), ("spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")):
        table = fim.Pieces(raw)
        table.cut([fim._offset(text, raw, a), fim._offset(text, raw, b)])
        table.arrange(fim.ORDERS[form])
        assert table.text() == want and table.digest() == hashlib.sha256(want.encode()).hexdigest()
        back = fim.Pieces.of_output(want.encode(), fim.ORDERS[form])
        assert back.text() == text and back.digest() == hashlib.sha256(raw).hexdigest()


def test_rows(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "has <S> in it", "\U0001f600é" * 50, "word " * 60_000, *("".join(rng.choices("ab<P é", k=30)) for _ in range(150))]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "no id here", "x"), (5, "word " * 60_000, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = fim.restore(fim.arrange(df))
    assert got.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored", "restored_sha256"]
    got = got.collect()
    assert len(got) == len(rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        text = r.text or ""
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        n = len(text)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        plain = not text or any(m in text for m in fim.SENTINELS) or h3 % 100 >= 90
        form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
        want = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
        assert (r.n, r.form, r.output, r.restored) == (n, form, want, text)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if plain else (a, b - a))
        assert (r.output_sha256, r.restored_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (want, text))
    assert fim.restore(fim.arrange(df.limit(0))).count() == 0


@pytest.mark.parametrize("output, form", [("<P>a<M>b", "psm"), ("a<P>b<S>c<M>", "psm"), ("<P><S><M>", "spm"), ("x", "other"), (None, "plain"), ("x", None)])
def test_outputs_that_no_form_gives(spark, output, form):
    r = fim.restore(spark.createDataFrame([(output, form)], "output string, form string")).first()
    assert r.restored is None and r.restored_sha256 is None


def test_shares_of_forms(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'some text' as text")
    got = {r.form: r["count"] for r in fim.arrange(df, plain=50, spm=50).groupBy("form").count().collect()}
    assert abs(got["plain"] - 2000) < 150 and abs(got["spm"] - 1000) < 150 and abs(got["psm"] - 1000) < 150
