"""Binary sources: keyframes from a Matroska seek index, fixed-size raw frames. Arrow batches in and out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids.
HEADER, SEGMENT, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
INFO, TIMESTAMP_SCALE = 0x1549A966, 0x2AD7B1
TRACKS, TRACK, TRACK_NUMBER, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x83
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK = 0xBB, 0xB3, 0xB7, 0xF7
HEAD_BYTES = 16 << 20


def varint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """The variable-length integer at `at` and where it ends."""
    size = 9 - data[at].bit_length()
    if size > 8 or at + size > len(data):
        raise ValueError("not a variable-length integer")
    value = int.from_bytes(data[at : at + size], "big")
    return (value if keep_marker else value & (1 << 7 * size) - 1), at + size


def element(data: bytes, at: int) -> tuple[int, int, int]:
    """(id, size of the body, where it begins) of the element at `at`."""
    kind, at = varint(data, at, True)
    size, at = varint(data, at, False)
    return kind, size, at


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of each element between at and end."""
    while at < end:
        kind, size, begin = element(data, at)
        yield kind, begin, begin + size
        at = begin + size


def _numbers(data: bytes, begin: int, end: int) -> dict[int, int]:
    return {kind: int.from_bytes(data[b:e], "big") for kind, b, e in children(data, begin, end)}


def index_place(head: bytes, total_size: int) -> tuple[int, int, int] | None:
    """(offset of the index, nanoseconds of a tick, number of the first video track); null for anything out of order."""
    try:
        kind, size, begin = element(head, 0)
        if kind != HEADER:
            return None
        kind, _, begin = element(head, begin + size)
        if kind != SEGMENT:
            return None
        place, tick, track = None, 1_000_000, None
        for kind, b, e in children(head, begin, len(head) - 8):
            if kind == CLUSTER:
                break
            if kind == SEEK_HEAD:
                for seek in (_numbers(head, *x[1:]) for x in children(head, b, e) if x[0] == SEEK):
                    if seek.get(SEEK_ID) == CUES and SEEK_POSITION in seek:
                        place = begin + seek[SEEK_POSITION]
            elif kind == INFO:
                tick = _numbers(head, b, e).get(TIMESTAMP_SCALE, tick)
            elif kind == TRACKS:
                found = [_numbers(head, *x[1:]) for x in children(head, b, e) if x[0] == TRACK]
                track = next((t.get(TRACK_NUMBER) for t in found if t.get(TRACK_TYPE) == 1), track) if track is None else track
    except (IndexError, ValueError):
        return None
    return None if place is None or track is None or place >= total_size else (place, tick, track)


def index_keyframes(body: bytes, track: int, tick: int, fps: float) -> list[tuple[int, float]] | None:
    """Distinct sorted (frame, seconds) of the index's points for the track; null if out of order or without frame 0."""
    found = set()
    try:
        for kind, b, e in children(body, 0, len(body)):
            if kind != CUE_POINT:
                continue
            time, mine = None, False
            for part, pb, pe in children(body, b, e):
                if part == CUE_TIME:
                    time = int.from_bytes(body[pb:pe], "big")
                elif part == CUE_POSITIONS:
                    mine = mine or any(k == CUE_TRACK and int.from_bytes(body[x:y], "big") == track for k, x, y in children(body, pb, pe))
            if time is not None and mine:
                seconds = time * tick / 1e9
                found.add((round(seconds * fps), seconds))
    except (IndexError, ValueError):
        return None
    table = sorted(found)
    return table if table and table[0][0] == 0 else None


def keyframes(files: DataFrame, fps: float) -> DataFrame:
    """(path, frame, pts_time) from files (path, content) as spark.read.format("binaryFile") gives them; files without a usable index give none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"], strict=True):
                content = bytes(content or b"")
                at = index_place(content[:HEAD_BYTES], len(content))
                if at is None:
                    continue
                try:
                    kind, size, begin = element(content, at[0])
                except (IndexError, ValueError):
                    continue
                rows = index_keyframes(content[begin : begin + size], at[2], at[1], fps) if kind == CUES and begin + size <= len(content) else None
                out += [(path, f, t) for f, t in rows or []]
            yield pd.DataFrame(out, columns=["path", "frame", "pts_time"])

    return files.select("path", "content").mapInPandas(run, "path string, frame long, pts_time double")


def frame_scores(files: DataFrame, record_bytes: int) -> DataFrame:
    """(path, frame, score): mean absolute difference of each whole record to the one before (0 for the first); a short tail is dropped."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                n = len(content) // record_bytes
                frames = np.frombuffer(content, dtype=np.uint8, count=n * record_bytes).reshape(n, record_bytes)
                score = np.zeros(n)
                for i in range(1, n):
                    score[i] = np.abs(frames[i].astype(np.int16) - frames[i - 1]).mean()
                yield pd.DataFrame({"path": path, "frame": np.arange(n), "score": score})

    return files.select("path", F.coalesce("content", F.lit(b"")).alias("content")).mapInPandas(run, "path string, frame long, score double")
