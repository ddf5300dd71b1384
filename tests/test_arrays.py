import os

import numpy as np
import pytest

from bitloom.sources import arrays


@pytest.fixture(scope="module")
def session(spark):
    arrays.register(spark)
    return spark


def values(df, name="value"):
    return [r[name] for r in df.orderBy("row").collect()]


@pytest.mark.parametrize("kind", ["<f4", "<f8", "<i8", "<i4", "<i2", "i1", "u1", "<u4", "?", ">f4", "S5", "<U4"])
def test_types(session, tmp_path, kind):
    a = np.array(["ab", "c", "déf"[:2], ""]).astype(kind) if kind in ("<U4",) else np.array([b"ab", b"c", b"", b"xyz"]).astype(kind) if kind == "S5" else np.array([1, 0, 1, 100 if kind != "?" else 1]).astype(kind)
    np.save(tmp_path / "a.npy", a)
    want = [x.decode() if isinstance(x, bytes) else x for x in a.tolist()]
    assert values(session.read.format("npy").load(str(tmp_path / "a.npy"))) == want


def test_a_file_of_many_ranges_and_several_files(session, tmp_path):
    rng = np.random.default_rng(1)
    whole = rng.normal(size=(1003, 7)).astype(np.float32)
    np.save(tmp_path / "a.npy", whole[:700])
    np.save(tmp_path / "b.npy", whole[700:])
    np.save(tmp_path / "_hidden.npy", whole)
    df = session.read.format("npy").option("rows", 97).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 8 + 4
    got = df.orderBy("row").collect()
    assert [r.row for r in got] == list(range(1003)) and np.array_equal(np.array([r.value for r in got], np.float32), whole)


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives_and_fewer_columns(session, tmp_path, save):
    ids, vectors, names = np.arange(500) * 3, np.random.default_rng(2).normal(size=(500, 4)), np.array([f"n{k}" for k in range(500)])
    save(tmp_path / "a.npz", ids=ids, vectors=vectors, names=names)
    df = session.read.format("npz").option("rows", 64).load(str(tmp_path / "a.npz"))
    assert df.columns == ["row", "ids", "vectors", "names"]
    got = df.orderBy("row").collect()
    assert [r.ids for r in got] == ids.tolist() and [r.names for r in got] == names.tolist() and np.array_equal([r.vectors for r in got], vectors)
    one = session.read.format("npz").schema("names string").load(str(tmp_path / "a.npz"))
    assert one.columns == ["names"] and one.count() == 500


def faulty(tmp_path):
    a = np.arange(100.0)
    np.save(tmp_path / "cut.npy", a)
    raw = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(raw[:-9])
    (tmp_path / "none.npy").write_bytes(b"no array at all")
    np.save(tmp_path / "object.npy", np.array([{}, 1], object))
    np.save(tmp_path / "column.npy", np.asfortranarray(np.ones((3, 4))))
    np.save(tmp_path / "three.npy", np.ones((2, 2, 2)))
    np.save(tmp_path / "complex.npy", np.ones(3, complex))
    np.savez(tmp_path / "ragged.npz", a=np.ones(3), b=np.ones(4))
    np.savez(tmp_path / "whole.npz", a=a)
    (tmp_path / "cut.npz").write_bytes((tmp_path / "whole.npz").read_bytes()[:-60])


@pytest.mark.parametrize("name, says", [("cut.npy", "truncated"), ("none.npy", "no array header"), ("object.npy", "which no column"), ("column.npy", "column order"), ("three.npy", "two dimensions"), ("complex.npy", "which no column"), ("ragged.npz", "rows"), ("cut.npz", "truncated"), ("missing.npy", "missing")])
def test_files_that_are_no_tables(session, tmp_path, name, says):
    faulty(tmp_path)
    with pytest.raises(Exception, match=says):
        session.read.format(name[-3:]).load(str(tmp_path / name)).count()


def test_a_schema_that_does_not_fit(session, tmp_path):
    np.savez(tmp_path / "a.npz", a=np.ones(3, np.float32))
    for schema, says in (("a double", "is float, not double"), ("a array<float>", "is float"), ("b float", "no array b")):
        with pytest.raises(Exception, match=says):
            session.read.format("npz").schema(schema).load(str(tmp_path / "a.npz")).count()


def test_writing(session, tmp_path):
    df = session.range(1000).selectExpr("id", "array(cast(id as float), 0.5f) as v", "concat('n', id) as name", "id % 2 = 0 as even").repartition(3)
    path = str(tmp_path / "out")
    df.write.format("npz").mode("overwrite").option("rows", 150).save(path)
    files = sorted(os.listdir(path))
    assert "_SUCCESS" in files and len(files) == 1 + 9 and not [f for f in files if f.startswith("_") and f != "_SUCCESS"]
    assert np.load(f"{path}/{files[1]}")["v"].shape == (150, 2)
    got = session.read.format("npz").load(path).drop("row")
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    df.limit(10).write.format("npz").mode("append").save(path)
    assert session.read.format("npz").load(path).count() == 1010
    df.limit(7).coalesce(1).write.format("npz").mode("overwrite").save(path)
    assert session.read.format("npz").load(path).count() == 7
    df.select("v").write.format("npy").mode("overwrite").save(f"{path}-npy")
    assert session.read.format("npy").load(f"{path}-npy").count() == 1000


@pytest.mark.parametrize("sql, says", [("if(id = 5, null, id) as x", "nulls"), ("if(id = 5, array(1), array(1, 2)) as x", "lists of"), ("array(if(id = 5, null, id)) as x", "nulls in them")])
def test_what_no_array_can_hold_leaves_nothing(session, tmp_path, sql, says):
    path = tmp_path / "bad"
    with pytest.raises(Exception, match=says):
        session.range(10).selectExpr(sql).coalesce(1).write.format("npy").mode("overwrite").save(str(path))
    assert not path.exists() or not [f for f in os.listdir(path) if not f.startswith("_")]


def test_an_empty_table(session, tmp_path):
    path = str(tmp_path / "empty")
    session.range(0).write.format("npy").mode("overwrite").save(path)
    assert session.read.format("npy").schema("value long").load(path).count() == 0
