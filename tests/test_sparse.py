import numpy as np
import pytest

from bitloom.sources import sparse


def tables(spark, matrix):
    """CSR parts of a dense matrix, by numpy."""
    rows, columns = np.nonzero(matrix)
    indptr = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(matrix)))])
    make = lambda v, kind: spark.createDataFrame([(k, x) for k, x in enumerate(v.tolist())], f"place long, value {kind}")
    return make(indptr, "long"), make(columns, "long"), make(matrix[rows, columns], "double")


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_a_matrix_with_empty_rows(spark, block):
    rng = np.random.default_rng(block)
    matrix = np.where(rng.random((60, 23)) < 0.15, rng.normal(size=(60, 23)), 0.0)
    matrix[[0, 5, 6, 59]] = 0
    matrix[30] = rng.normal(size=23)  # a row over several blocks
    found = sparse.entries(*tables(spark, matrix), block=block)
    assert found.count() == np.count_nonzero(matrix)
    for lo, hi in ((0, 23), (4, 9), (22, 23)):
        got = {r.row: r.vector for r in sparse.dense(found, spark.range(60).withColumnRenamed("id", "row"), lo, hi).collect()}
        assert np.array_equal(np.array([got[k] for k in range(60)]), matrix[:, lo:hi])


def test_there_and_back(spark):
    rng = np.random.default_rng(3)
    cells = [(int(r), int(c), float(v)) for r, c, v in zip(rng.integers(0, 9000, 400), rng.integers(0, 10, 400), rng.normal(size=400))]
    cells = list({(r, c): (r, c, v) for r, c, v in cells}.values())
    df = spark.createDataFrame(cells, "row long, column long, value double").repartition(5)
    back = sparse.entries(*sparse.csr(df), block=16)
    assert sorted(tuple(r) for r in back.collect()) == sorted(cells)
    assert [t.count() for t in sparse.csr(df.limit(0))] == [0, 0, 0]
