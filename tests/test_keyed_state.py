"""Row-wise state against the batch operators, and what it writes."""

import random
import time

import pytest

from segmentry.operators import scenes
from segmentry.streaming import keyed_state


@pytest.fixture
def restored(spark):
    before = spark.conf.get(keyed_state.PROVIDER)
    yield spark
    spark.conf.set(keyed_state.PROVIDER, before)


def feed(spark, folder, rows, shape, each):
    for i in range(0, len(rows), each):
        spark.createDataFrame(rows[i : i + each], shape).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, df, tmp_path, name, **trigger):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination(240)
    return sorted(tuple(r) for r in spark.table(name).collect()), q


def test_cuts_equal_the_batch(restored, tmp_path):
    rng = random.Random(8)
    rows = [(s, f, rng.choice([10, 100, 2000])) for s in (1, 2) for f in range(50)]
    mixed = rows[:]
    rng.shuffle(mixed)
    mixed += [(1, 3, 9), (1, None, 5), (2, 4, None)]
    shape = "source_id long, frame long, score long"
    stream = feed(restored, str(tmp_path / "in"), mixed, shape, 30)
    batch = scenes.min_gap(scenes.candidate_cuts(restored.createDataFrame(rows, shape)), 6)
    got, _ = run(restored, keyed_state.cuts(stream, gap=6), tmp_path, "keyed_cuts")
    assert got == sorted((r.source_id, r.frame) for r in batch.collect())


def test_order_survives_a_restart(restored, tmp_path):
    shape, folder, out = "source_id long, idx long", str(tmp_path / "in"), str(tmp_path / "out")

    def emitted(rows, each):
        stream = feed(restored, folder, rows, shape, each)
        q = keyed_state.in_order(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        return sorted(tuple(r) for r in restored.read.parquet(out).collect())

    assert emitted([(1, 3), (1, 0), (2, 1), (1, 3), (1, None), (2, 2)], 2) == [(1, 0)]
    assert emitted([(1, 1), (2, 0), (1, 2), (1, 0), (1, 9)], 3) == [(s, i) for s, n in ((1, 4), (2, 3)) for i in range(n)]


def test_a_batch_writes_what_is_new(restored, tmp_path):
    shape = "source_id long, frame long, score long"
    waiting = [(1, f, 10) for f in range(1, 401)]  # frame 0 is missing: all wait
    stream = feed(restored, str(tmp_path / "in"), waiting + [(1, f, 10) for f in range(401, 411)], shape, 400)
    got, q = run(restored, keyed_state.cuts(stream), tmp_path, "writes")
    updated = [sum(s["numRowsUpdated"] for s in p["stateOperators"]) for p in q.recentProgress if p["numInputRows"]]
    assert got == [] and updated[0] >= 400 and updated[1] <= 20, updated


def test_an_idle_source_is_dropped(restored, tmp_path):
    shape, folder = "source_id long, idx long", str(tmp_path / "in")
    want = [[(1, 0)], [(1, 0), (2, 0)], [(1, 0), (1, 0), (2, 0)]]  # at last source 1 begins anew
    stream = feed(restored, folder, [(1, 0), (1, 5)], shape, 2)
    # with timers by the clock a query never runs out of batches, so it is watched and stopped
    q = keyed_state.in_order(stream, idle=1).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        for rows, seen in zip(([], [(2, 0)], [(1, 0)]), want, strict=True):
            if rows:
                feed(restored, folder, rows, shape, 1)
            until = time.time() + 40
            while sorted(tuple(r) for r in restored.table("idle").collect()) != seen and time.time() < until and q.isActive:
                time.sleep(0.5)
            assert sorted(tuple(r) for r in restored.table("idle").collect()) == seen
            time.sleep(2)  # idle for longer than its timer
    finally:
        q.stop()
