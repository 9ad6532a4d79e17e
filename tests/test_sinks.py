"""The ordered append: any order, restarts and failures give the bytes of one pass."""

import os
import random

import pytest
from pyspark.sql import functions as F

from segmentry.streaming import sinks

SCHEMA = "source_id string, idx long, path string"


def chunks(tmp_path, sizes, seed=1):
    """The rows and what each source's file must be."""
    rng = random.Random(seed)
    os.makedirs(tmp_path / "chunks", exist_ok=True)
    rows, want = [], {}
    for source, n in sizes.items():
        for i in range(n):
            data = rng.randbytes(rng.randrange(0, 40))
            path = tmp_path / "chunks" / f"{rng.getrandbits(60):x}.obu"
            path.write_bytes(data)
            rows.append((source, i, str(path)))
            want[source] = want.get(source, b"") + data
    rng.shuffle(rows)
    return rows, want


def fed(spark, tmp_path, rows, per_batch):
    for i in range(0, len(rows), per_batch):
        spark.createDataFrame(rows[i : i + per_batch], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def expected(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "source_id string, expected long")


def contents(done):
    return {r.source_id: open(r.path, "rb").read() for r in done.collect()}


def test_restarts_give_the_bytes_of_one_pass(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SEGMENT", 4)
    sizes = {"a": 17, "b/ü c": 6, "one": 1}
    rows, want = chunks(tmp_path, sizes)
    stream = fed(spark, tmp_path, rows + rows[:3], 5)  # some come twice
    out, mark = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    sink = sinks.OrderedAppend(spark, out)
    failures = iter(["before", "segments", "state", "before"])
    real, written = sink.append, sinks._written

    def failing(batch, batch_id):
        at = next(failures, None) if batch_id in (1, 2, 4) else None
        if at == "before":
            raise RuntimeError("killed before the batch")
        if at == "segments":  # half of the segments are there
            monkeypatch.setattr(sinks, "_written", lambda ready, path: written(ready.filter("idx % 2 = 0"), path))
            real(batch.limit(0), 10**6 + batch_id)  # another batch id: nothing of it may count
            written(batch.filter("idx < 1").select("source_id", "idx", "path"), out + "/stray").collect()
            monkeypatch.setattr(sinks, "_written", written)
            sink._drop(f"{out}/_state/batch-{10**6 + batch_id:012d}")
            raise RuntimeError("killed between segments")
        real(batch, batch_id)
        if at == "state":
            raise RuntimeError("killed after the state")

    runs = 0
    while True:
        sink.append = failing
        q = sink.start(stream, mark, availableNow=True)
        runs += 1
        try:
            q.awaitTermination()
            break
        except Exception as e:
            assert "killed" in str(e) and runs < 9
    assert runs == 5
    done = sink.finish(expected(spark, sizes))
    assert contents(done) == want and {r.source_id: r.bytes for r in done.collect()} == {s: len(b) for s, b in want.items()}
    assert not os.listdir(tmp_path / "chunks")  # all chunk files are gone
    assert contents(sink.finish(expected(spark, sizes))) == want  # finishing again changes nothing


def test_batches_by_hand(spark, tmp_path):
    sizes = {"a": 5}
    rows, want = chunks(tmp_path, sizes)
    rows.sort()
    sink = sinks.OrderedAppend(spark, str(tmp_path / "out"), keep=True)
    batch = lambda *which: spark.createDataFrame([rows[i] for i in which], SCHEMA)
    sink.append(batch(1, 3), 0)
    assert [tuple(r) for r in sink.marks().collect()] == [("a", 0)]
    with pytest.raises(ValueError, match="0 of 5"):
        sink.finish(expected(spark, sizes))
    sink.append(batch(0, 1), 1)
    sink.append(batch(0, 1), 1)  # replayed
    assert [tuple(r) for r in sink.marks().collect()] == [("a", 2)]
    sink.append(spark.createDataFrame([("a", None, "x"), (None, 1, "x"), ("a", 0, "gone")], SCHEMA), 2)
    sink.append(batch(2).limit(0), 3)
    assert sorted((r.kind, r.idx) for r in sink.state().collect()) == [("mark", 2), ("waiting", 3)]
    sink.append(batch(2, 4), 4)
    assert contents(sink.finish(expected(spark, sizes))) == want and len(os.listdir(tmp_path / "chunks")) == 5
    assert len(os.listdir(tmp_path / "out" / "_state")) <= 4  # old states are gone


def test_a_missing_chunk_fails_its_batch_only(spark, tmp_path):
    rows, want = chunks(tmp_path, {"a": 2})
    rows.sort()
    sink = sinks.OrderedAppend(spark, str(tmp_path / "out"))
    lost = spark.createDataFrame([(rows[0][0], 0, str(tmp_path / "lost"))], SCHEMA)
    with pytest.raises(Exception, match="lost"):
        sink.append(lost, 0)
    assert sink.marks().count() == 0
    sink.append(spark.createDataFrame(rows, SCHEMA), 0)
    assert contents(sink.finish(expected(spark, {"a": 2}))) == want


def test_chunks_go_after_the_next_batch(spark, tmp_path):
    rows, _ = chunks(tmp_path, {"a": 2})
    rows.sort()
    sink = sinks.OrderedAppend(spark, str(tmp_path / "out"))
    sink.append(spark.createDataFrame(rows[:1], SCHEMA), 0)
    assert os.path.exists(rows[0][2])
    sink.append(spark.createDataFrame(rows[1:], SCHEMA).withColumn("more", F.lit(1)), 1)
    assert not os.path.exists(rows[0][2]) and os.path.exists(rows[1][2])
