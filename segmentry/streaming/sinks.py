"""Ordered append: finished chunks of many sources, put behind one another in order while later ones still come.

Chunks are files; a stream names them (source_id, idx, path) in any order. Of each source the run without a gap from its
high-water mark on is appended; what comes after a gap waits. A batch appends by writing segments: a segment is one
file with the bytes of some consecutive chunks, named by the first of them, so a source's segments in the order of their
names are the chunks in order, and a source with many chunks is written by many tasks.

What a batch leaves (marks, waiting chunks, chunks appended) is one table a batch, whose success marker commits it. A
batch that is run again, after a failure at any point, starts from the table of the batch before and writes the same
segments again. Chunk files go only when the batch after theirs begins: until then their batch may have to be repeated.

Defined cases: an index that comes again, below the mark or waiting, is ignored (of two paths in one batch the first in
order counts); null sources, indexes or paths are ignored; an empty batch moves nothing; a chunk file that can't be read
fails its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from segmentry.operators.scenes import require_complete
from segmentry.sources.raw import fs, opened

#: Chunks of a source that one task puts into one segment.
SEGMENT = 256
COPY = 8 << 20
_STATE = "kind string, source_id string, idx long, path string"


class OrderedAppend:
    """The folder of an ordered append: segments by source and the state after each batch. `keep` leaves the chunk files."""

    def __init__(self, spark: SparkSession, path: str, keep: bool = False):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _committed(self) -> list[int]:
        """The batches whose state is whole."""
        system, at = self._at(f"{self.path}/_state")
        if not system.exists(at):
            return []
        names = [s.getPath().getName() for s in system.listStatus(at)]
        return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-") and system.exists(self._at(f"{self.path}/_state/{n}/_SUCCESS")[1]))

    def state(self, before: int | None = None) -> DataFrame:
        """(kind, source_id, idx, path) after the last committed batch, or the last before one: marks (idx is the next due), chunks that wait, chunks appended last."""
        done = [b for b in self._committed() if before is None or b < before]
        return self.spark.read.schema(_STATE).parquet(f"{self.path}/_state/batch-{done[-1]:012d}") if done else self.spark.createDataFrame([], _STATE)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """One batch of (source_id, idx, path); for foreachBatch."""
        old = self.state(before=batch_id)
        if not self.keep:
            _deleted(old.filter("kind = 'appended'")).write.format("noop").mode("overwrite").save()
        marks = old.filter("kind = 'mark'").select("source_id", F.col("idx").alias("due"))
        new = batch.select(F.col("source_id").cast("string").alias("source_id"), F.col("idx").cast("long").alias("idx"), "path").dropna()
        waits = old.filter("kind = 'waiting'").select("source_id", "idx", "path", F.lit(0).alias("age")).unionByName(new.withColumn("age", F.lit(1)))
        due = F.coalesce("due", F.lit(0).cast("long"))
        first = waits.groupBy("source_id", "idx").agg(F.min(F.struct("age", "path")).getField("path").alias("path"))
        have = first.join(marks, "source_id", "left").withColumn("due", due).filter("idx >= due")
        # where a source's run ends: the first index, from the one before the mark on, without a successor
        begun = have.select("source_id", (F.col("due") - 1).alias("idx")).distinct()
        after = have.select("source_id", (F.col("idx") - 1).alias("idx"))
        ends = have.select("source_id", "idx").unionByName(begun).join(after, ["source_id", "idx"], "left_anti").groupBy("source_id").agg((F.min("idx") + 1).alias("upto"))
        # the batch's plan, before anything is written: everything below reads it, and so agrees
        plan = f"{self.path}/_state/plan-{batch_id:012d}"
        have.join(ends, "source_id").withColumn("ready", F.col("idx") < F.col("upto")).write.mode("overwrite").parquet(plan)
        planned = self.spark.read.parquet(plan)
        _written(planned.filter("ready"), self.path).write.format("noop").mode("overwrite").save()
        moved = planned.groupBy("source_id").agg(F.max("upto").alias("idx"))
        still = marks.join(moved, "source_id", "left_anti").select("source_id", F.col("due").alias("idx"))
        none = F.lit(None).cast("string").alias("path")
        state = moved.unionByName(still).select(F.lit("mark").alias("kind"), "source_id", "idx", none)
        rest = planned.select(F.when(F.col("ready"), F.lit("appended")).otherwise(F.lit("waiting")).alias("kind"), "source_id", "idx", "path")
        state.unionByName(rest).write.mode("overwrite").parquet(f"{self.path}/_state/batch-{batch_id:012d}")
        self._drop(plan)
        for b in [b for b in self._committed() if b < batch_id][:-1]:  # the one before may still be needed
            self._drop(f"{self.path}/_state/batch-{b:012d}")

    def _drop(self, path: str) -> None:
        system, at = self._at(path)
        system.delete(at, True)

    def start(self, chunks: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """The query that appends a stream of chunks."""
        return chunks.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def marks(self) -> DataFrame:
        """(source_id, run): how many chunks of each source are appended."""
        return self.state().filter("kind = 'mark'").select("source_id", F.col("idx").alias("run"))

    def finish(self, expected: DataFrame) -> DataFrame:
        """(source_id, path, bytes) of one file for each source; ValueError where a source of expected (source_id, expected) isn't complete.

        The files are made anew from the segments, which then go, as do chunk files still there.
        """
        need = expected.select(F.col("source_id").cast("string").alias("source_id"), "expected")
        require_complete(self.marks(), need, "source_id")
        out = f"{self.path}/_state/finished"
        _joined(self.marks().filter("run > 0"), self.path).write.mode("overwrite").parquet(out)
        if not self.keep:
            _deleted(self.state().filter("kind = 'appended'")).write.format("noop").mode("overwrite").save()
        return self.spark.read.parquet(out)


def _folder(path: str, source: str) -> str:
    return f"{path}/segments/{quote(source, safe='')}"


def _copied(paths: list[str], to: str) -> int:
    """The files' bytes in one file, which is there as a whole or not at all."""
    system, at = opened(to)
    system.create_dir(at.rsplit("/", 1)[0])
    part, size = f"{at}.part-{pd.util.hash_array(pd.Series(paths).to_numpy())[0]:x}", 0
    with system.open_output_stream(part) as out:
        for path in paths:
            source, begin = opened(path)
            with source.open_input_stream(begin) as data:
                while block := data.read(COPY):
                    out.write(block)
                    size += len(block)
    system.move(part, at)
    return size


def _written(ready: DataFrame, path: str) -> DataFrame:
    """Writes the segments of chunks (source_id, idx, path): one for each SEGMENT indexes of a source."""
    dealt = ready.withColumn("_part", F.floor(F.col("idx") / SEGMENT)).select("source_id", "_part", "idx", "path").repartition("source_id", "_part").sortWithinPartitions("source_id", "_part", "idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, int, int, str]] = []

        def flushed() -> pd.DataFrame:
            source, _, first, _ = held[0]
            return pd.DataFrame({"source_id": [source], "idx": [first], "bytes": [_copied([h[3] for h in held], f"{_folder(path, source)}/{first:012d}")]})

        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if held and held[0][:2] != row[:2]:
                    yield flushed()
                    held = []
                held.append(row)
        if held:
            yield flushed()

    return dealt.mapInPandas(run, "source_id string, idx long, bytes long")


def _joined(sources: DataFrame, path: str) -> DataFrame:
    """One file of each source's segments, in the order of their names."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source in batch["source_id"]:
                folder, to = _folder(path, source), f"{path}/{quote(source, safe='')}"
                system, at = opened(folder)
                found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
                names = sorted(i.base_name for i in found if i.base_name.isdigit())
                if names:
                    rows.append((source, to, _copied([f"{folder}/{n}" for n in names], to)))
                    system.delete_dir(at)
                else:  # an earlier attempt got that far
                    system, at = opened(to)
                    rows.append((source, to, system.get_file_info(at).size))
            yield pd.DataFrame(rows, columns=["source_id", "path", "bytes"])

    return sources.select("source_id").repartition("source_id").mapInPandas(run, "source_id string, path string, bytes long")


def _deleted(chunks: DataFrame) -> DataFrame:
    """Deletes the files of chunks, if they are there."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                system, at = opened(path)
                if system.get_file_info(at).type == fs.FileType.File:
                    system.delete_file(at)
            yield pd.DataFrame({"n": [len(batch)]})

    return chunks.select("path").mapInPandas(run, "n long")
