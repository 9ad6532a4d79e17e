"""Shared plumbing: tables of a folder, lineage cuts, guarded broadcasts, folds and row keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of 64-bit keys that may be broadcast (about 16 MB in memory as a hashed relation each million).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(spark: SparkSession) -> None:
    """From now on the session sends rows to Python workers in batches of BATCH_BYTES at most, unless it has a smaller limit.

    A batch stands in buffers of up to twice its size outside the heap, and again in the worker: at Spark's 64 MB that is
    several hundred MB an executor, which it keeps beside the next stage's heap.
    """
    if int(spark.conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where nothing sets it, a new one in local mode, else ValueError."""
    sc = spark.sparkContext
    set_by = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not set_by:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_by = tempfile.mkdtemp(prefix="segmentry-")  # one machine, one process
        sc.setCheckpointDir(set_by)
    return set_by.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended
        pass


Held = list[tuple[SparkSession, str]]
#: Tables of the scratch under way; None outside any.
_HELD: ContextVar[Held | None] = ContextVar("held", default=None)


def _write(df: DataFrame, name: str, held: Held | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/segmentry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if held is None:
        atexit.register(_remove, spark, path)
    else:
        held.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and a lost executor costs nothing.

    The table goes with the scratch it is written in, else when the session's process ends.
    """
    return _write(df, name, _HELD.get())


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside go when it ends. It gives a `written` for results: those belong to the scratch around this one."""
    outer, mine = _HELD.get(), []
    token = _HELD.set(mine)
    try:
        yield lambda df, name: _write(df, name, outer)
    finally:
        _HELD.reset(token)
        drop(mine)


def drop(held: Held) -> None:
    for spark, path in held:
        _remove(spark, path)
    held.clear()


def stepped(first: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """The steps one after the other, each on the written result of the one before, which goes when its successor is written."""
    now, outer, before = first, _HELD.get(), []
    for i, (name, step) in enumerate(steps):
        held: Held | None = outer if i == len(steps) - 1 else []
        with scratch():
            now = _write(step(now), name, held)
        drop(before)
        before = held if held is not outer else []
    return now


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """docs' columns `own` and all columns as the struct `row`, so that no name of theirs meets one of an operator's."""
    return docs.select(*own, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def beside(docs: DataFrame) -> DataFrame:
    """docs' text and all other columns as the struct `row`, so that workers get a text once."""
    others = [c for c in docs.columns if c != "text"] or ["text"]
    return docs.select("text", F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"))


def unpacked(rows: DataFrame, columns: list[str], changed: dict[str, Column], added: dict[str, Column] | None = None) -> DataFrame:
    """The columns of `row` with those `changed` in their place, and those `added` at the end (in place of any so named)."""
    added = added or {}
    kept = [changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns if c not in added]
    return rows.select(*kept, *(v.alias(k) for k, v in added.items()))


def text_changed(text: Column, columns: list[str]) -> dict[str, Column]:
    """What a new text changes: itself and, where there is one, n_chars."""
    return {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in columns else {})


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `limit` rows, each element of an array and each eight bytes of a string counting as one more."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    wide = [F.coalesce(F.size(c), F.lit(0)) if t == "array" else F.coalesce(F.octet_length(c), F.lit(0)) / 8 for c, t in kinds.items() if t in ("array", "string")]
    if df.limit(limit + 1).count() > limit:
        return False
    return not wide or (df.agg(F.sum(sum(wide, F.lit(1)))).first()[0] or 0) <= limit


def near(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written side of a join: to be broadcast where it is small, else shuffled."""
    return F.broadcast(df) if small(df, limit) else df


def semi(df: DataFrame, keys: DataFrame, on: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is in `keys`: by broadcast if `keys` is small, else by a shuffled join."""
    return df.join(near(keys, limit), on, "left_semi")


def fold(key: Column, of: int) -> Column:
    """crc32 of the key as text modulo `of`; a null key is in no fold (-1)."""
    return F.coalesce(F.crc32(key.cast("string")) % F.lit(of), F.lit(-1)).cast("int")


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(rows with a unique non-null `rid` and `text`, how rids map back or None).

    Where every id is unique and not null, rid is the id. Otherwise equal rows (same id and text) get
    one rid, and rids follow the order (id with null first, text); the second frame has rid, the id
    and how many rows share it.
    """
    plain = docs.select(F.col(key).alias("rid"), F.col(text).alias("text"))
    odd = plain.groupBy("rid").count().filter("count > 1 OR rid IS NULL").limit(1).count()
    if not odd:
        return plain.filter("rid IS NOT NULL").withColumn("rid", F.col("rid").cast("long")), None
    rows = plain.groupBy(F.col("rid").alias("id"), "text").agg(F.count("*").alias("copies"))
    ordered = rows.repartitionByRange("id", "text").sortWithinPartitions("id", "text").withColumn("rid", F.monotonically_increasing_id())
    kept = written(ordered, "keys")
    return kept.select("rid", "text"), kept.select("rid", "id", "copies")


def unkeyed(result: DataFrame, back: DataFrame | None, key: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """The result with its ids back in place of rid (and of the rids in the columns `also`), one row for each input row."""
    if back is None:
        return result.withColumnRenamed("rid", key)
    out = result.join(back, "rid").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_copy", "copies", "rid")
    for c in also:
        out = out.join(back.select(F.col("rid").alias(c), F.col("id").alias("_as")), c).drop(c).withColumnRenamed("_as", c)
    return out.withColumnRenamed("id", key)
