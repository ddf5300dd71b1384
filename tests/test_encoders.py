import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions import encoders


@pytest.fixture
def own():
    names = []

    def make(name, **more):
        names.append(name)
        return encoders.register(encoders.Encoder(name, **more))

    yield make
    for name in names:
        encoders.ENCODERS.pop(name, None)


def test_both_kinds_over_repeated_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(40, 64)).astype(np.float32)
    vectors[3] = 0
    rows = [(k, vectors[k % 40].tolist()) for k in range(130)] + [(900, None)]
    df = spark.createDataFrame(rows, "id int, v array<float>").repartition(4)
    at = np.arange(64)
    turned = np.array([[(-1) ** bin(i & j).count("1") for j in at] for i in at])
    for name, want in (("signs", np.where(vectors >= 0, 1, -1)), ("hadamard", np.where(np.round(vectors.astype(float) @ turned.T, 6) >= 0, 1, -1))):
        for got in (df.withColumn("code", encoders.encode(F.col("v"), name)), encoders.encode_distinct(df, "v", name)):
            got = {r.id: r.code for r in got.collect()}
            assert len(got) == 131 and got[900] is None and all(got[k] == want[k % 40].tolist() for k in range(130))


def test_each_distinct_vector_is_encoded_once(spark, own, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def make():
        def run(vectors):
            import uuid

            (seen / uuid.uuid4().hex).write_text(str(len(vectors)))
            return np.sign(vectors) + (vectors == 0)

        return run

    own("counting", takes=2, width=2, batches=make)
    df = spark.createDataFrame([([float(k % 5), -1.0],) for k in range(1000)], "v array<float>")
    assert encoders.encode_distinct(df, "v", "counting").count() == 1000
    encoders.encode_distinct(df, "v", "counting").write.format("noop").mode("overwrite").save()
    assert max(int(f.read_text()) for f in seen.iterdir()) <= 5


@pytest.mark.parametrize("vector", [[1.0], [1.0, None], [1.0, float("nan")], [1.0, float("inf")], [1.0, 2.0, 3.0]])
def test_vectors_that_break_the_contract(spark, own, vector):
    own("two", takes=2, width=2, column=lambda v: F.transform(v, lambda x: F.lit(1.0)))
    df = spark.createDataFrame([(vector,)], "v array<float>")
    with pytest.raises(Exception, match="two takes 2 finite numbers"):
        df.select(encoders.encode(F.col("v"), "two")).collect()


def test_codes_that_break_the_contract(spark, own):
    own("narrow", takes=2, width=2, column=lambda v: F.slice(v, 1, 1))
    own("outside", takes=2, width=2, batches=lambda: lambda v: v * 0 + 3)
    own("fewer", takes=2, width=2, batches=lambda: lambda v: v[:0])
    own("endless", takes=2, width=2, domain=None, batches=lambda: lambda v: v / 0)
    df = spark.createDataFrame([([1.0, 1.0],)], "v array<float>")
    for name, says in (("narrow", "not 2 numbers"), ("outside", "not 2 numbers"), ("fewer", "gave 0 codes"), ("endless", "finite size")):
        with pytest.raises(Exception, match=says):
            df.select(encoders.encode(F.col("v"), name)).collect()


def test_names(own):
    own("one", takes=1, width=1, column=lambda v: v)
    with pytest.raises(ValueError, match="there already"):
        own("one", takes=1, width=1, column=lambda v: v)
    with pytest.raises(ValueError, match="column or batches"):
        encoders.register(encoders.Encoder("none", 1, 1))
    with pytest.raises(ValueError, match="no encoder other"):
        encoders.encoder("other")
