"""Quotas of many sources and shards, and blocks of the benchmark, in bounded memory."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentry.llm import decontaminate, mixing


def test_runs_are_the_quotas_in_disjoint_order():
    quotas = np.array([7, 0, 300, 1, 64], dtype=np.int64)
    t = mixing.runs(quotas, 9).to_pandas()
    for k, q in enumerate(quotas):
        mine = t[t.k == k].sort_values("begin")
        assert list(mine.begin) == [0, *mine.end[:-1]][: len(mine)] and (mine.end.max() if len(mine) else 0) == q and list(mine.shard) == sorted(mine.shard)
    dense = mixing.split(quotas, 9)
    assert (dense.sum(axis=0) == quotas).all() and {(r.shard, r.k, r.end - r.begin) for r in t.itertuples()} == {(s, k, dense[s, k]) for s, k in zip(*np.nonzero(dense), strict=True)}
    assert mixing.runs(np.zeros(3, dtype=np.int64), 4).num_rows == 0 and mixing.runs(np.zeros(0, dtype=np.int64), 4).num_rows == 0


@pytest.mark.parametrize(("sources", "blocks", "shards", "most"), [(100_000, 1024, 64, 500e6), (1_000, 4_000, 320_000, 500e6)])
def test_driver_memory_is_bounded(sources, blocks, shards, most):
    tracemalloc.start()
    t = mixing.runs(np.full(sources, blocks, dtype=np.int64), shards)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < most and int((t["end"].to_numpy() - t["begin"].to_numpy()).sum()) == sources * blocks


def test_each_source_has_its_own_permutation(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source"), F.lit(1).alias("k"))
    planned, shards = mixing.plan(rows, 16, ("doc_id",))
    got = planned.select("doc_id", "mix_source", "size", "taken", F.transform("copies", lambda c: c["words"]).alias("w"), F.transform("copies", lambda c: c["shard"]).alias("s")).collect()
    assert len(got) == 4000 and all(sum(r.w) == r.taken <= 3 * r.size for r in got)
    used = {}
    for r in got:
        for s in r.s:
            assert 0 <= s < shards
            used.setdefault(r.mix_source, set()).add(s)
    assert all(len(u) == 16 for u in used.values())


def test_blocks_of_the_benchmark_run_in_chains(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHAIN", 2)
    docs = spark.createDataFrame([(i, " ".join(f"w{i + j}" for j in range(30))) for i in range(0, 200, 7)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"w{i + j}" for j in range(12))) for i in range(0, 220, 3)], "item_id long, text string")
    one = sorted(map(tuple, decontaminate.benchmark_hits(docs, items, ["doc_id"]).collect()))
    chained = decontaminate.benchmark_hits(docs, items, ["doc_id"], block_bytes=900)
    assert sorted(map(tuple, chained.collect())) == one and any(r[3] for r in one)
    assert chained._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2
