import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bitloom.llm import mixing, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_the_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == COLUMNS
            out.write.parquet(str(tmp_path / name))
            out = spark.read.parquet(str(tmp_path / name))
            after = {r.doc_id: r for r in out.collect()}
            assert after.items() <= before.items()
            kept[name] = (before, after)
        docs = out
    before, after = kept["toxicity"]
    clean = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in clean) >= 0.95 * len(clean)
    before, after = kept["language"]
    assert len(after) >= 0.98 * len(before)
    before, after = kept["near_duplicates"]
    prints = {i: simhash.fingerprint(r.text) for i, r in before.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert after.keys() == {find(i) for i in prints}
    before, after = kept["mixing"]
    assert 0 < len(after) < len(before)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = docs.collect()
    assert len(got) == len(after) and all(r.round_trip and r.ids == library.encode(after[r.doc_id].text, add_special_tokens=False).ids for r in got)


def test_odd_rows_pass_every_stage(spark, sf):
    rows = [(1, None, None, None, None, 1, "x"), (2, "", "en", "s", 0, 2, "x"), (None, "the only words here", "en", "s", 1, 3, None), (3, "same words here again", "en", "s", 1, 4, None), (3, "same words here again", "en", "s", 1, 4, None), (4, "long text " * 20_000, "en", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, row string")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, sf)
            assert name == "bpe" or out.columns == docs.columns
            assert out.count() <= some.count()
    got = sorted((r.doc_id or 0) for r in corpus_pipeline.one_of_each(spark, docs, sf).collect())
    assert got == [0, 1, 3, 4]


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and got.where(~F.col("round_trip")).count() == 0
    assert mixing.BUDGET < 1
