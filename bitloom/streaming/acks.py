"""Acknowledgements of chunks as streaming state: the frontier of each cell, and what waits beyond it.

Chunks of a cell are numbered from 0 and may arrive in any order, twice, or not at all. A chunk is released when all before it have been;
its receipt then goes into the cell's hash chain. Spark keeps the state with the stream's offsets, so that a run that ends between taking
a chunk in and acknowledging it goes on from where its last whole batch was.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Chunks of a cell that wait for an earlier one at most. Others are refused: they stay unacknowledged, and their sender has them still.
HELD = 4096
#: Groups that cells are dealt to by hash. A group's cells are taken in by one call and share a state, so that a call does not cost more than
#: its work; a state grows with the cells over this number. It belongs to a stream and must not change while its offsets are kept.
GROUPS = 4096
START = "0" * 64
_EVENTS = "cell string, ordinal long, event string, chain string"


def step(frontier: int, chain: str, waiting: dict[int, str], arrived: list[tuple[int, str]], held: int) -> tuple[int, str, list[tuple[int, str, str | None]]]:
    """Takes in chunks (ordinal, receipt) and changes `waiting`: the new frontier and chain, and events (ordinal, event, chain).

    released: in its turn; repeated: had been released, or waits already; rebound: waits with another receipt, which stays; early: has to
    wait; refused: `held` chunks wait already; invalid: no ordinal of 0 or more, or no receipt.
    """
    events: list[tuple[int, str, str | None]] = []
    for ordinal, receipt in arrived:
        if ordinal is None or ordinal < 0 or receipt is None:
            events.append((ordinal, "invalid", None))
        elif ordinal < frontier or waiting.get(ordinal) == receipt:
            events.append((ordinal, "repeated", None))
        elif ordinal in waiting:
            events.append((ordinal, "rebound", None))
        elif ordinal > frontier and len(waiting) >= held:
            events.append((ordinal, "refused", None))
        else:
            if ordinal > frontier:
                events.append((ordinal, "early", None))
            waiting[ordinal] = receipt
            while frontier in waiting:
                chain = hashlib.sha256((chain + waiting.pop(frontier)).encode()).hexdigest()
                events.append((frontier, "released", chain))
                frontier += 1
    return frontier, chain, events


def acknowledge(chunks: DataFrame, held: int = HELD, groups: int = GROUPS) -> DataFrame:
    """(cell, ordinal, event, chain) of a stream of chunks (cell, ordinal, receipt); chain: of released chunks, the cell's up to there.

    A cell's chunks of one batch are taken in by ordinal, then receipt. State is a frontier, a hash and at most `held` receipts a cell.
    """

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cells = {c: (f, chain, {int(k): v for k, v in waiting.items()}) for c, f, chain, waiting in (json.loads(state.get[0]) if state.exists else ())}
        arrived: dict[str | None, list[tuple[int | None, str | None]]] = {}
        for rows in frames:
            for cell, ordinal, receipt in zip(*(rows[c].tolist() for c in ("cell", "ordinal", "receipt"))):
                arrived.setdefault(cell, []).append((None if pd.isna(ordinal) else int(ordinal), receipt))
        found = []
        for cell, own in arrived.items():
            own.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or ""))
            frontier, chain, waiting = cells.get(cell, (0, START, {}))
            frontier, chain, events = step(frontier, chain, waiting, own, held)
            cells[cell] = frontier, chain, waiting
            found += [(cell, *e) for e in events]
        state.update((json.dumps([(c, *v) for c, v in cells.items()]),))
        if found:
            yield pd.DataFrame(found, columns=["cell", "ordinal", "event", "chain"]).astype({"ordinal": "Int64"})

    dealt = chunks.select("cell", "ordinal", "receipt", F.pmod(F.xxhash64("cell"), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInPandasWithState(follow, _EVENTS, "cells string", "append", GroupStateTimeout.NoTimeout)


def events_of_batch(batch: DataFrame, number: int, folder: str) -> None:
    batch.write.mode("overwrite").parquet(f"{folder}/events/batch={number}")


def run(spark: SparkSession, path: str, folder: str, files: int = 4, held: int = HELD) -> None:
    """Takes in the chunks below `path` that have not been taken in before, `files` files to a batch, and leaves their events in `folder`.

    A batch's events are written over whatever an earlier attempt at it left, and its offsets count only after that.
    """
    source = spark.readStream.schema("cell string, ordinal long, receipt string").option("maxFilesPerTrigger", files).parquet(path)
    acknowledge(source, held).writeStream.foreachBatch(lambda batch, number: events_of_batch(batch, number, folder)).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{_EVENTS}, batch int").parquet(f"{folder}/events")


def frontiers(found: DataFrame) -> DataFrame:
    """(cell, released, waiting, repeated, chain) of events: where each cell stands. Chunks wait that came early and are not released."""
    n = lambda e: F.count_if(F.col("event") == e)
    late = found.where("event in ('early', 'released')").groupBy("cell", "ordinal").agg(n("released").alias("done")).groupBy("cell").agg(F.count_if(F.col("done") == 0).alias("waiting"))
    per = found.groupBy("cell").agg(n("released").alias("released"), n("repeated").alias("repeated"), F.max_by("chain", F.when(F.col("event") == "released", F.col("ordinal"))).alias("chain"))
    return per.join(late, "cell", "left").select("cell", "released", F.coalesce("waiting", F.lit(0)).alias("waiting"), "repeated", F.coalesce("chain", F.lit(START)).alias("chain"))
