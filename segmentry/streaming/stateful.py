"""Structured Streaming operators with a state for each source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def in_order(results: DataFrame) -> DataFrame:
    """(source_id, idx) of results as far as they reach from 0 without a gap: later ones wait for those missing.

    The state is the next index due and those that wait; an index that comes again is ignored.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, waiting = state.get if state.exists else (0, [])
        held = set(waiting)
        for part in parts:
            held.update(int(i) for i in part["idx"] if i >= due)
        begin = due
        while due in held:
            held.remove(due)
            due += 1
        state.update((due, sorted(held)))
        yield pd.DataFrame({"source_id": key[0], "idx": range(begin, due)})

    return results.select("source_id", "idx").groupBy("source_id").applyInPandasWithState(step, "source_id long, idx long", "due long, waiting array<long>", "append", GroupStateTimeout.NoTimeout)


def cuts(frames: DataFrame, width: int = 2, least: int = 1500, ratio: int = 3, gap: int = 1) -> DataFrame:
    """(source_id, frame) of accepted cuts of a stream of (source_id, frame, score); frames may come out of order.

    A frame is judged when its neighbours are there; the state holds the frames that still wait or serve as neighbours,
    and the last accepted cut. Over a whole stream this equals candidate cuts followed by the minimum gap.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, scores, last = state.get if state.exists else (0, {}, 0)
        held = {int(k): int(v) for k, v in dict(scores).items()}
        for part in parts:
            held.update((int(f), int(s)) for f, s in zip(part["frame"], part["score"], strict=True) if f >= first)
        out, centre = [], first + width
        while all(i in held for i in range(centre - width, centre + width + 1)):
            around = sum(held[i] for i in range(centre - width, centre + width + 1)) - held[centre]
            if held[centre] >= least and 2 * width * held[centre] >= ratio * around and centre - last >= gap:
                out.append(centre)
                last = centre
            del held[centre - width]
            centre += 1
        state.update((centre - width, held, last))
        yield pd.DataFrame({"source_id": key[0], "frame": pd.Series(out, dtype="int64")})

    return frames.select("source_id", "frame", "score").groupBy("source_id").applyInPandasWithState(step, "source_id long, frame long", "first long, scores map<long,long>, last long", "append", GroupStateTimeout.NoTimeout)
