"""Large binary files by seeking: fixed-size raw frames as a data source, and seek indexes without the files' bodies.

Files are opened where a task runs, through Arrow's file systems (local, HDFS, S3, GCS), and only the ranges that a
part needs are read, so a file of any size is split like a table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from .binary import CUES, HEAD_BYTES, element, index_keyframes, index_place
from .tables import settled

#: Seconds by which a frame may come before the window's begin.
SLACK = 0.005


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def size_of(path: str) -> int:
    """Bytes of a file; -1 where there is none."""
    system, at = opened(path)
    info = system.get_file_info(at)
    return info.size if info.type == fs.FileType.File else -1


def frame_window(total: int, fps: float | None = None, seek: float | None = None, to: float | None = None, max_frames: int | None = None) -> tuple[int, int]:
    """The frames [begin, end) of `total` with seek - SLACK <= time < to, `max_frames` of them at most."""
    begin, end = 0, total
    if seek is not None:
        begin = min(total, max(0, math.ceil((seek - SLACK) * fps - 1e-9)))
    if to is not None:
        end = min(total, max(begin, math.ceil(to * fps - 1e-9)))
    if max_frames is not None:
        end = min(end, begin + max_frames)
    return begin, max(begin, end)


@dataclass
class _Part(InputPartition):
    path: str
    begin: int
    end: int
    first: int


class RawFrames(DataSource):
    """spark.read.format("raw_frames"): rows (path, frame, data) of files of fixed-size records; a short tail is dropped.

    Options: path (several by commas), record_bytes; fps, seek, to (seconds) and max_frames for a window, in which frames
    count from 0 again; part_frames, the frames of a task; decode=false leaves data null and reads no payload;
    pushdown=true takes filters on path and frame, so that only their byte ranges are read (Spark wants
    spark.sql.python.filterPushdown.enabled for that).

    As a stream (path, record_bytes, part_frames and decode only; folders stand for their files): each batch has the whole records
    that files have grown by, new files included. Offsets are frames by path, so a restart goes on behind the last batch.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return "path string, frame long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushdown", "false").lower() == "true" else _RawReader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _RawStream(self.options)


def _read_records(partition: _Part, record: int, decode: bool) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("path", pa.string()), ("frame", pa.int64()), ("data", pa.binary())])
    step = max(1, (8 << 20) // record)
    source = None
    if decode and partition.end > partition.begin:
        system, at = opened(partition.path)
        source = system.open_input_file(at)
        source.seek(partition.begin * record)
    for at in range(partition.begin, partition.end, step):
        n = min(step, partition.end - at)
        data = [source.read(record) if source else None for _ in range(n)]
        yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(range(at - partition.first, at - partition.first + n), pa.int64()), pa.array(data, pa.binary())], schema=kinds)
    if source:
        source.close()


class _RawReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        def number(name: str, kind):
            return kind(options[name]) if name in options else None

        self.paths = [p.strip() for p in options["path"].split(",")]
        self.record = int(options["record_bytes"])
        self.fps, self.seek, self.to, self.most = number("fps", float), number("seek", float), number("to", float), number("max_frames", int)
        self.part = number("part_frames", int) or 1 << 12
        self.decode = options.get("decode", "true").lower() != "false"

    def wanted(self, path: str, first: int, begin: int, end: int) -> tuple[int, int]:
        """What is to be read of a file's frames [begin, end), of which `first` is its frame 0."""
        return begin, end

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            first, end = frame_window(max(0, size_of(path)) // self.record, self.fps, self.seek, self.to, self.most)
            begin, end = self.wanted(path, first, first, end)
            out += [_Part(path, at, min(end, at + self.part), first) for at in range(begin, end, self.part)]
        return out or [_Part("", 0, 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return _read_records(partition, self.record, self.decode)


class _PushingReader(_RawReader):
    """Takes filters on path and frame; those that bounds say in full are not checked again by Spark."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.low, self.high = 0, math.inf
        self.only: list[Callable[[str], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("frame",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if column == ("frame",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            known = column == ("frame",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull))
            if column == ("frame",) and isinstance(f, In):  # bounds, and Spark picks from what is between them
                values = [v for v in f.value if v is not None]
                self.low, self.high = max(self.low, min(values, default=0)), min(self.high, max(values, default=-1))
            if column == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.only.append(lambda path, f=f: isinstance(f, IsNotNull) or (path == f.value if isinstance(f, EqualTo) else path in f.value if isinstance(f, In) else path.startswith(f.value)))
                known = True
            if not known:
                yield f

    def wanted(self, path: str, first: int, begin: int, end: int) -> tuple[int, int]:
        if not all(ok(path) for ok in self.only):
            return begin, begin
        low = max(begin, first + max(0, self.low))
        return low, max(low, int(min(end, first + self.high + 1)))


class _RawStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.record, self.part = int(options["record_bytes"]), int(options.get("part_frames", 1 << 12))
        self.decode = options.get("decode", "true").lower() != "false"

    def _files(self) -> list[str]:
        out = []
        for path in self.paths:
            system, at = opened(path)
            if system.get_file_info(at).type == fs.FileType.Directory:
                out += [f"{path.rstrip('/')}/{i.base_name}" for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
            else:
                out.append(path)
        return sorted(out)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: max(0, size_of(p)) // self.record for p in self._files()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = [_Part(p, at, min(end[p], at + self.part), 0) for p in sorted(end) for at in range(start.get(p, 0), end[p], self.part)]
        return out or [_Part("", 0, 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return _read_records(partition, self.record, self.decode)


def raw_frames(spark: SparkSession, path: str, record_bytes: int, **options: object) -> DataFrame:
    """(path, frame, data) of RawFrames; filters on path and frame bound what is read where the session lets Python sources take them."""
    spark.dataSource.register(RawFrames)
    options.setdefault("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    reader = spark.read.format("raw_frames").option("path", path).option("record_bytes", record_bytes)
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, v)
    return reader.load()


def raw_frame_stream(spark: SparkSession, path: str, record_bytes: int, **options: object) -> DataFrame:
    """The stream (path, frame, data) of the whole records of growing files."""
    spark.dataSource.register(RawFrames)
    reader = spark.readStream.format("raw_frames").option("path", path).option("record_bytes", record_bytes)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def frame_counts(paths: DataFrame, record_bytes: int) -> DataFrame:
    """(path, frames) by the files' sizes alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "frames": [max(0, size_of(p)) // record_bytes for p in part["path"]]})

    return paths.select("path").mapInPandas(run, "path string, frames long")


def frame_scores(paths: DataFrame, record_bytes: int, part_frames: int = 1 << 12) -> DataFrame:
    """(path, frame, score): mean absolute difference of each whole record to the one before (0 for the first).

    Files are read in ranges of `part_frames` records, each with the record before it.
    """
    ranges = frame_counts(paths, record_bytes).filter("frames > 0").select("path", "frames", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(part_frames).cast("long"))).alias("begin"))
    dealt = ranges.repartition("path", "begin")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, frames, begin in zip(part["path"], part["frames"], part["begin"], strict=True):
                system, at = opened(path)
                with system.open_input_file(at) as source:
                    end, before, scores = min(frames, begin + part_frames), None, []
                    source.seek(max(0, begin - 1) * record_bytes)
                    if begin:
                        before = np.frombuffer(source.read(record_bytes), dtype=np.uint8).astype(np.int16)
                    for _ in range(begin, end):
                        now = np.frombuffer(source.read(record_bytes), dtype=np.uint8).astype(np.int16)
                        scores.append(0.0 if before is None else float(np.abs(now - before).mean()))
                        before = now
                yield pd.DataFrame({"path": path, "frame": np.arange(begin, end), "score": scores})

    return dealt.mapInPandas(run, "path string, frame long, score double")


def seek_keyframes(paths: DataFrame, fps: float) -> DataFrame:
    """(path, frame, pts_time) by the files' seek indexes: their first HEAD_BYTES and the index are read, nothing else.

    Files without a usable index give no rows.
    """

    def table(path: str) -> list[tuple[int, float]]:
        try:
            total = size_of(path)
            system, at = opened(path)
            with system.open_input_file(at) as source:
                found = index_place(source.read(min(HEAD_BYTES, max(0, total))), total)
                if found is None:
                    return []
                source.seek(found[0])
                kind, size, begin = element(source.read(12), 0)
                if kind != CUES or found[0] + begin + size > total:
                    return []
                source.seek(found[0] + begin)
                return index_keyframes(source.read(size), found[2], found[1], fps) or []
        except (IndexError, OSError, ValueError):
            return []

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(p, f, t) for p in part["path"] for f, t in table(p)], columns=["path", "frame", "pts_time"])

    return paths.select("path").mapInPandas(run, "path string, frame long, pts_time double")


def keyframe_table(paths: DataFrame, packets: DataFrame, fps: float) -> DataFrame:
    """(path, frame, pts_time): by seek index for Matroska files that have one, else by packets (path, frame, pts_time)."""
    indexed = settled(seek_keyframes(paths.filter(F.lower("path").rlike(r"\.(mkv|mka|webm)$")), fps), "indexed")
    rest = paths.select("path").join(indexed.select("path").distinct(), "path", "left_anti")
    return indexed.unionByName(packets.select("path", "frame", "pts_time").join(rest, "path", "left_semi"))
