"""Ordered emission and cut detection on RocksDB state that changes row by row.

Each source has a small head (the next index due, the last accepted cut) and a map with what waits. A batch reads and writes
only what its own rows touch: new rows go into the map unless they are used at once, and leave it when they are. The results
are those of `stateful`, which rewrites a source's whole state in each batch.

With `idle` (milliseconds), a source without new rows for so long is done: its state goes when its timer ends.

Defined cases: rows with a null frame, index or score are ignored, as are frames and indexes already passed; of several scores
of a waiting frame the last counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Waiting(StatefulProcessor):
    """A head and a map by source, and the timer of an idle one."""

    def __init__(self, head: str, value: str, idle: int | None):
        self.shape, self.kind, self.idle = head, value, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", self.shape)
        self.waiting = handle.getMapState("waiting", "at long", self.kind)

    def begun(self, otherwise: tuple) -> tuple:
        return tuple(self.head.get()) if self.head.exists() else otherwise

    def watch(self, timerValues: Any) -> None:
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def again(self, new: dict[int, int], met: dict[int, int | None]) -> None:
        """Notes which of the batch's places are in the map as well, so that they leave it too."""
        for at in new:
            found = self.waiting.getValue((at,))
            met[at] = None if found is None else found[0]

    def held(self, at: int, new: dict[int, int], met: dict[int, int | None]) -> int | None:
        """What waits at a place: of this batch, else of the map, which is asked once."""
        if at in new:
            return new[at]
        if at not in met:
            found = self.waiting.getValue((at,))
            met[at] = None if found is None else found[0]
        return met[at]

    def passed(self, at: int, new: dict[int, int], met: dict[int, int | None]) -> None:
        new.pop(at, None)
        if met.pop(at, None) is not None:
            self.waiting.removeKey((at,))

    def keep(self, new: dict[int, int]) -> None:
        for at, value in new.items():
            self.waiting.updateValue((at,), (value,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.head.clear()
        self.waiting.clear()
        yield from ()

    def close(self) -> None:
        pass


class _InOrder(_Waiting):
    def __init__(self, idle: int | None):
        super().__init__("due long", "seen int", idle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (due,), new, met = self.begun((0,)), {}, {}
        for part in rows:
            new.update((int(i), 1) for i in part["idx"].dropna() if i >= due)
        begin = due
        self.again(new, met)
        while self.held(due, new, met) is not None:
            self.passed(due, new, met)
            due += 1
        self.keep({at: v for at, v in new.items() if met.get(at) is None})
        if due != begin or not self.head.exists():
            self.head.update((due,))
        self.watch(timerValues)
        yield pd.DataFrame({"source_id": key[0], "idx": pd.Series(range(begin, due), dtype="int64")})


class _Cuts(_Waiting):
    def __init__(self, width: int, least: int, ratio: int, gap: int, idle: int | None):
        super().__init__("first long, last long", "score long", idle)
        self.width, self.least, self.ratio, self.gap = width, least, ratio, gap

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (first, last), new, met, w = self.begun((0, 0)), {}, {}, self.width
        for part in rows:
            known = part.dropna(subset=["frame", "score"])
            new.update((int(f), int(s)) for f, s in zip(known["frame"], known["score"], strict=True) if f >= first)
        self.again(new, met)
        out, begin = [], first
        while True:
            around = [self.held(i, new, met) for i in range(first, first + 2 * w + 1)]
            if any(s is None for s in around):
                break
            centre, score = first + w, around[w]
            if score >= self.least and 2 * w * score >= self.ratio * (sum(around) - score) and centre - last >= self.gap:
                out.append(centre)
                last = centre
            self.passed(first, new, met)
            first += 1
        self.keep(new)
        if first != begin or not self.head.exists():
            self.head.update((first, last))
        self.watch(timerValues)
        yield pd.DataFrame({"source_id": key[0], "frame": pd.Series(out, dtype="int64")})


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed state needs, for queries that start from now on."""
    spark.conf.set(PROVIDER, ROCKSDB)


def _transformed(rows: DataFrame, processor: _Waiting, shape: str) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    return rows.groupBy("source_id").transformWithStateInPandas(processor, shape, "append", "None" if processor.idle is None else "ProcessingTime")


def in_order(results: DataFrame, idle: int | None = None) -> DataFrame:
    """(source_id, idx) of a stream of results as far as they reach from 0 without a gap: later ones wait for those missing."""
    return _transformed(results.select("source_id", "idx"), _InOrder(idle), "source_id long, idx long")


def cuts(frames: DataFrame, width: int = 2, least: int = 1500, ratio: int = 3, gap: int = 1, idle: int | None = None) -> DataFrame:
    """(source_id, frame) of accepted cuts of a stream of (source_id, frame, score); frames may come out of order."""
    return _transformed(frames.select("source_id", "frame", "score"), _Cuts(width, least, ratio, gap, idle), "source_id long, frame long")
