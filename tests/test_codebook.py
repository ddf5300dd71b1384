import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import codebook


@pytest.mark.parametrize(("n", "bits"), [(10, 16), (10, 32), (24, 32), (80, 64), (1, 16)])
def test_prototypes_are_far_apart(n, bits):
    p = codebook.prototypes(n, bits)
    assert len(set(p)) == n and all(0 <= x < 1 << bits for x in p) and p == codebook.prototypes(n, bits)
    if n > 1:
        assert min((a ^ b).bit_count() for i, a in enumerate(p) for b in p[:i]) >= bits // 4
    with pytest.raises(ValueError, match="codes"):
        codebook.prototypes(1 << 12, 3)


def test_strict_tables_fall():
    t = codebook.strict_table(np.array([1.0, 1.0 - 1e-12, 1.0 - 2e-12, 0.5]))
    assert (np.diff(t) < 0).all() and t[-1] == 0.5


def test_kept_bits_and_restriction(spark):
    stats = spark.createDataFrame([(0, 0.1), (1, 0.9), (2, 0.9), (3, 0.5)], "bit int, score double")
    bits = [r.bit for r in codebook.kept_bits(stats, 3).orderBy("place").collect()]
    assert bits == [1, 2, 3]
    assert spark.range(16).select(codebook.restrict(F.col("id"), bits).alias("c")).collect() == [(i >> 1,) for i in range(16)]
