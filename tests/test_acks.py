import hashlib
import random

import pytest

from bitloom.streaming import acks


def chain(receipts):
    h = acks.START
    for r in receipts:
        h = hashlib.sha256((h + r).encode()).hexdigest()
    return h


def test_any_order_releases_in_turn():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(0, 12)
        lost = set(rng.sample(range(n), rng.randint(0, min(2, n))))
        sent = [(k, f"r{k}") for k in range(n) if k not in lost]
        sent += rng.choices(sent, k=rng.randint(0, 5)) if sent else []
        rng.shuffle(sent)
        frontier, own, waiting, seen = 0, acks.START, {}, []
        while sent:
            some, sent = sent[: (cut := rng.randint(1, 4))], sent[cut:]
            frontier, own, events = acks.step(frontier, own, waiting, some, 100)
            seen += events
        edge = min([*lost, n])
        assert frontier == edge and own == chain(f"r{k}" for k in range(edge))
        assert [o for o, e, _ in seen if e == "released"] == list(range(edge)) and set(waiting) == set(range(edge, n)) - lost


def test_odd_chunks_and_a_bounded_wait():
    waiting = {}
    frontier, _, events = acks.step(0, acks.START, waiting, [(None, "x"), (-1, "x"), (0, None), (3, "a"), (3, "b"), (3, "a"), (2, "c"), (5, "d"), (0, "e"), (0, "e"), (5, "d")], 2)
    assert [(o, e) for o, e, _ in events] == [(None, "invalid"), (-1, "invalid"), (0, "invalid"), (3, "early"), (3, "rebound"), (3, "repeated"), (2, "early"), (5, "refused"), (0, "released"), (0, "repeated"), (5, "refused")]
    assert frontier == 1 and waiting == {3: "a", 2: "c"}
    frontier, _, events = acks.step(1, acks.START, waiting, [(1, "f"), (5, "d")], 2)
    assert frontier == 4 and [e for _, e, _ in events] == ["released"] * 3 + ["early"]


@pytest.mark.parametrize("stop", [1, 2])
def test_a_run_that_ends_between_taking_in_and_acknowledging(spark, tmp_path, monkeypatch, stop):
    rows = [(f"c{k % 5}", k // 5, f"r{k}") for k in range(200)] + [("c1", 3, "r16"), (None, 0, "n")]
    random.Random(stop).shuffle(rows)
    path, folder = str(tmp_path / "sent"), f"file://{tmp_path}/out"
    spark.createDataFrame(rows, "cell string, ordinal long, receipt string").repartition(4).write.parquet(path)
    real = acks.events_of_batch
    batches = []

    def breaking(batch, number, folder):
        batches.append(number)
        if len(batches) == stop + 1:
            batch.count()  # the chunks have been taken in, but not acknowledged
            raise RuntimeError("stopped here")
        real(batch, number, folder)

    monkeypatch.setattr(acks, "events_of_batch", breaking)
    with pytest.raises(Exception, match="stopped here"):
        acks.run(spark, path, folder, 1)
    monkeypatch.setattr(acks, "events_of_batch", real)
    acks.run(spark, path, folder, 1)
    acks.run(spark, path, folder, 1)  # nothing is left
    got = {r.cell: r for r in acks.frontiers(acks.events(spark, folder)).collect()}
    for c in range(5):
        assert got[f"c{c}"].released == 40 and got[f"c{c}"].waiting == 0 and got[f"c{c}"].chain == chain(f"r{k}" for k in range(c, 200, 5))
    assert got["c1"].repeated == 1 and got[None].released == 1


def test_new_files_go_on_from_the_state(spark, tmp_path):
    path, folder = str(tmp_path / "sent"), f"file://{tmp_path}/out"
    put = lambda *rows: spark.createDataFrame(rows, "cell string, ordinal long, receipt string").coalesce(1).write.mode("append").parquet(path)
    put(("a", 0, "x"), ("a", 2, "z"))
    acks.run(spark, path, folder)
    assert [(r.released, r.waiting) for r in acks.frontiers(acks.events(spark, folder)).collect()] == [(1, 1)]
    put(("a", 1, "y"), ("a", 0, "x"))
    acks.run(spark, path, folder)
    r = acks.frontiers(acks.events(spark, folder)).first()
    assert (r.released, r.waiting, r.repeated, r.chain) == (3, 0, 1, chain("xyz"))


def test_cells_share_calls_and_states(spark, tmp_path, monkeypatch):
    """Many cells go through few groups: no call for each cell, and each keeps its own frontier."""
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(str(c), i, f"{c}.{i}") for c in range(300) for i in range(4) if i != 1 or c % 2]
    spark.createDataFrame([*rows, (None, 0, "none")], "cell string, ordinal long, receipt string").repartition(3).write.parquet(path)
    monkeypatch.setattr(acks.acknowledge, "__defaults__", (acks.HELD, 5))
    acks.run(spark, path, folder, 1)
    got = {r.cell: (r.released, r.waiting) for r in acks.frontiers(acks.events(spark, folder).where("cell is not null")).collect()}
    assert got == {str(c): (4, 0) if c % 2 else (1, 2) for c in range(300)}
    assert acks.events(spark, folder).where("cell is null and event = 'released'").count() == 1
    state = spark.read.format("statestore").load(f"{folder}/offsets")
    assert 0 < state.count() <= 5
