"""A sink of ordered text: one file for each name, its lines in order, all files of a job or none."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from segmentry.operators.metrics import with_total

from .raw import opened

# The columns of a source's metrics, in order, what is summed, and what is averaged by frames.
METRICS = ("scene", "start_frame", "end_frame", "frames", "seek", "trim", "encode_sec", "fps", "size_mb", "ssim_all", "ssim_db", "psnr_avg", "ssim_y", "psnr_y")
SUMS = ("frames", "encode_sec", "size_mb")
MEANS = ("ssim_all", "ssim_db", "psnr_avg", "ssim_y", "psnr_y")


@dataclass
class _Made(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file is, and its name


class OrderedText(DataSource):
    """df.write.format("ordered_text"): rows (name, place, value), those of a name in one partition and in order.

    Options: path, the folder; suffix, added to each name. Tasks write into a staging folder of the job; the commit
    moves their files to their places, an abort drops the folder, whatever tasks have failed or been lost. Mode append
    fails if one of the files is there already; overwrite takes the place of all files of the folder.
    """

    @classmethod
    def name(cls) -> str:
        return "ordered_text"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _TextWriter(self.options, overwrite)


class _TextWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"].rstrip("/"), options.get("suffix", ""), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        made: list[tuple[str, str]] = []
        done, name, out = set(), None, None
        for batch in iterator:
            for key, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if key is None or value is None:
                    raise ValueError("a null name or line")
                if out is None or key != name:
                    if out is not None:
                        out.close()
                    if key in done:
                        raise ValueError(f"the lines of {key!r} aren't together")
                    done.add(key)
                    name, system, at = key, *opened(f"{self.staging}/{uuid.uuid4().hex}")
                    system.create_dir(at.rsplit("/", 1)[0])
                    out = system.open_output_stream(at)
                    made.append((at, key))
                out.write(value.encode() + b"\n")
        if out is not None:
            out.close()
        return _Made(made)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        system, folder = opened(self.path)
        system.create_dir(folder)
        try:
            if len({n for _, n in files}) < len(files):
                raise ValueError("the lines of a name are in several partitions")
            there = {i.base_name: i for i in system.get_file_info(fs.FileSelector(folder)) if not i.base_name.startswith("_staging-")}
            names = {quote(n, safe=" ") + self.suffix: at for at, n in files}
            taken = sorted(names.keys() & there.keys())
            if taken and not self.overwrite:
                raise ValueError(f"{taken[0]} is there already")
            for name, at in names.items():
                system.move(at, f"{folder}/{name}")
            for name, info in there.items():
                if self.overwrite and name not in names and info.type == fs.FileType.File:
                    system.delete_file(info.path)
        finally:
            self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at = opened(self.staging)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


def write_ordered(lines: DataFrame, path: str, suffix: str = "", mode: str = "append") -> None:
    """lines (name, place, value) as a file for each name, in the order of place."""
    lines.sparkSession.dataSource.register(OrderedText)
    rows = lines.select(F.col("name").cast("string").alias("name"), F.col("place").cast("long").alias("place"), F.col("value").cast("string").alias("value"))
    rows.repartition("name").sortWithinPartitions("name", "place").write.format("ordered_text").option("suffix", suffix).option("path", path).mode(mode).save()


def csv_lines(rows: DataFrame, by: str, order: str, columns: list[str], label: str = "total") -> DataFrame:
    """(name, place, value): for each value of `by` a header, its rows by the whole number in `order` as CSV, and last the row whose `order` is the label."""
    def cell(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))

    number = F.col(order).cast("string")
    place = F.when(number == label, F.lit(2**62)).otherwise(number.try_cast("long"))
    head = rows.select(F.col(by).alias("name")).distinct().select("name", F.lit(-1).cast("long").alias("place"), F.lit(",".join(columns)).alias("value"))
    return head.unionByName(rows.select(F.col(by).alias("name"), place.alias("place"), F.concat_ws(",", *map(cell, columns)).alias("value")))


def write_metric_files(rows: DataFrame, path: str, by: str, label: str = "total", mode: str = "append") -> None:
    """A CSV for each value of `by`: its rows (METRICS) by scene, then sums of frames, seconds and sizes and means by frames.

    Sums of seconds and sizes have one decimal, means five, both rounded as the binary value is; what a row lacks is empty.
    """
    total = with_total(rows.withColumn("_part", F.lit(0)), ["_part"], list(SUMS), list(MEANS), "frames", label, {"encode_sec": (2, 1), "size_mb": (2, 1)}, within=[by], mean_digits=5)
    last = total.filter(F.col("_part").cast("string") == label).drop("_part").withColumn("scene", F.lit(label))
    every = rows.select(by, *METRICS).withColumn("scene", F.col("scene").cast("string")).unionByName(last, allowMissingColumns=True)
    write_ordered(csv_lines(every, by, "scene", list(METRICS), label), path, ".csv", mode)
