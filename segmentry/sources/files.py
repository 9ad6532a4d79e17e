"""Discovery of input files and file sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.functions.rules import base_name, is_input


def discover(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path) of input videos, sorted by path parts: a file as it is, of a folder what is_input takes, of nothing none.

    The listing is the driver's, as names with a leading dot or underscore count, which Spark's own sources leave out.
    """
    top = Path(path)
    if top.is_file():
        found = [str(top)]
    else:
        found = sorted((str(p) for p in (top.rglob("*") if recursive else top.glob("*")) if p.is_file()), key=lambda p: Path(p).parts)
    rows = spark.createDataFrame([(p,) for p in found], "path string")
    return rows if top.is_file() else rows.filter(is_input(base_name(F.col("path")))).orderBy(F.split("path", "/"))


def write_scene_text(lines: DataFrame, path: str) -> None:
    """lines (scene, value) of one source as a text file, in order."""
    lines.orderBy("scene").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_metrics(rows: DataFrame, path: str, order: str, label: str = "total") -> None:
    """rows as CSV with a header, by `order`, the row labelled as total last; missing values are empty."""
    rows.orderBy(F.col(order) == label, order).coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")
