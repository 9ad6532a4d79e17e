"""Tables that end a lineage: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where nothing sets it, a new one in local mode, else ValueError."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="segmentry-")  # one machine, one process
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended
        pass


#: The tables of the scratch under way; None outside any.
_HELD: ContextVar[list[str] | None] = ContextVar("held", default=None)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what several branches of a plan read is made once.

    The table goes with the scratch it is made in, else when the process ends.
    """
    spark, held = df.sparkSession, _HELD.get()
    path = f"{shared_dir(spark)}/segmentry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if held is None:
        atexit.register(remove, spark, path)
    else:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables settled inside go when it ends; it gives their paths so far. A result that reads them is to be settled outside."""
    mine: list[str] = []
    token = _HELD.set(mine)
    try:
        yield mine
    finally:
        _HELD.reset(token)
        for path in mine:
            remove(spark, path)


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The frame that `make` gives. If tables were settled for it, it is a table itself (of the scratch around this, if any) and those are gone."""
    outer = _HELD.get()
    with scratch(spark) as mine:
        found = make()
        if not mine:
            return found
        token = _HELD.set(outer)
        try:
            return settled(found, name)
        finally:
            _HELD.reset(token)


def near(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A settled side of a join, of numbers and flags: to be broadcast if it has at most `limit` rows, else shuffled."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
