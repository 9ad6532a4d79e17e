"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A document's place is a hash of its id and text: its first bits name its block within its source (1,024 blocks, more
where one would hold over BLOCK_WORDS words), the next ten a part of the block. A source's share is a number of whole
passes over its documents and a rest in words. The rest is cut off exactly: sums by block find the block in which it
ends, sums by part the part, and a running sum over that part's few documents the document, which gives only the words
still missing. No step sees more of a source than about a millionth of it at once.

Output shards (SHARDS, more where one would hold over SHARD_WORDS words): every pass contributes a source's blocks (the
rest as many as it reaches). These block quotas are split over the shards by a binary tree: at each node the left half's
quotas are one draw from the multivariate hypergeometric distribution, by a generator of the node's own, so they add up
exactly at each level and each shard expects the same mixture; a node only looks at the sources that have blocks in it. A
source's blocks, permuted anew in each pass and for each source, are then dealt to the shards in disjoint runs as long as
their quotas; each shard is one partition and sorts its documents by a hash.

Sources are metadata: one row each on the driver, at most MAX_SOURCES (checked), and 24 bytes for each shard that a source
reaches. Runs become a list of shards by block in Spark; these lists are broadcast if they are short, else shuffled by source.

Defined cases: a null text has size 0, and rows of size 0 are never taken; a null source is a source of its
own, last in order; sources whose texts are all empty have target 0; repeated rows are rows of their own
(equal ones share a place); very long texts are counted and passed on whole; an empty table gives an empty result; other
columns pass through `mix`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import near, packed, unpacked, written

WEIGHTS = (5, 2, 1)
TIMES = 3
BLOCKS = 1024
BLOCK_WORDS = 2_000_000
SHARDS = 64
SHARD_WORDS = 50_000_000
SEED = 17
MAX_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, times: int = TIMES) -> list[float]:
    """Shares of sum(sizes) by weight; none above `times` its size, what is above reshared by weight."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(times * sizes[i] for i in capped)
        weight = sum(weights[i % len(weights)] for i in range(len(sizes)) if i not in capped)
        want = [float(times * s) if i in capped else left * weights[i % len(weights)] / weight for i, s in enumerate(sizes)]
        above = {i for i, s in enumerate(sizes) if i not in capped and want[i] > times * s}
        if not above:
            return want
        capped |= above


def generator(seed: int, node: int) -> np.random.Generator:
    """The generator of a node of the tree: 1 is the root, 2 n and 2 n + 1 are the halves of n."""
    return np.random.default_rng([seed, node])


def dealt(quotas: np.ndarray, shards: int, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """In order of shards: a shard, the sources that it gets blocks of, and how many. Sums over shards are the quotas."""
    def node(number: int, first: int, shards: int, of: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not len(of):
            return
        if shards == 1:
            yield first, of, n
            return
        left = shards // 2
        rng, whole = generator(seed, number), int(n.sum())
        # the left half takes its part of all blocks, rounded at random
        take = whole * left // shards + int(rng.random() * shards < whole * left % shards)
        got = rng.multivariate_hypergeometric(n, take, method="marginals") if take else np.zeros_like(n)
        for half, at, size, part in ((2 * number, first, left, got), (2 * number + 1, first + left, shards - left, n - got)):
            yield from node(half, at, size, of[part > 0], part[part > 0])

    live = np.flatnonzero(quotas)
    yield from node(1, 0, shards, live, quotas[live])


def split(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources: how many blocks of each source each shard gets."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    for shard, of, n in dealt(quotas, shards, seed):
        out[shard, of] = n
    return out


def runs(quotas: np.ndarray, shards: int, seed: int = SEED) -> pa.Table:
    """(k, begin, end, shard): the run [begin, end) of the blocks dealt of source k that each shard gets."""
    at, found = np.zeros(len(quotas), dtype=np.int64), []
    for shard, of, n in dealt(quotas, shards, seed):
        found.append((of.astype(np.int32), at[of], at[of] + n, np.full(len(of), shard, dtype=np.int32)))
        at[of] += n
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32())
    columns = [pa.array(np.concatenate(c) if found else [], t) for c, t in zip(zip(*found, strict=True) if found else [()] * 4, kinds, strict=True)]
    return pa.table(dict(zip(("k", "begin", "end", "shard"), columns, strict=True)))


def block_bits(size: int) -> int:
    """Bits of a place that name the block, in a source of that many words."""
    return (max(BLOCKS, -(-size // BLOCK_WORDS)) - 1).bit_length()


def _bits(begin: Column, size: Column) -> Column:
    """`size` bits of the place from bit `begin` on, counted from the highest."""
    return F.call_function("shiftrightunsigned", F.call_function("shiftleft", F.col("place"), begin), F.lit(64) - size).cast("int")


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """rows as a frame, by Arrow: of plain tuples Spark would make an RDD, for which each executor keeps more Python workers."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return spark.createDataFrame(pa.table({c: pa.array(v, kinds[t]) for c, v, t in zip(names, columns, types, strict=True)}))


def plan(docs: DataFrame, shards: int | None = None, keep: tuple[str, ...] = (), seed: int = SEED) -> tuple[DataFrame, int]:
    """Each row of docs (its columns `keep`) with size, source, source_size, target, taken and copies; the number of shards.

    copies: for each pass that takes the row, its number, the shard and the words taken, at most size.
    """
    spark = docs.sparkSession
    sized = docs.select(
        *keep, F.col("source").alias("_source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), "text").alias("place"),
    )
    # only texts that pass through are worth reading twice
    sized = sized if "row" in keep else written(sized, "sizes")
    known = sized.groupBy("_source").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(known) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    known = sorted(known, key=lambda r: (r._source is None, (r._source or "").encode("utf-8", "surrogatepass")))
    want = targets([r.s for r in known]) if sum(r.s for r in known) else [0.0] * len(known)
    shares = []
    for k, (r, t) in enumerate(zip(known, want, strict=True)):
        passes = min(TIMES, int(t // r.s)) if r.s else 0
        shares.append((r._source, r.s, t, passes, round(t) - passes * r.s if r.s and passes < TIMES else 0, block_bits(r.s), k))
    shards = shards or max(SHARDS, -(-sum(r.s for r in known) // SHARD_WORDS))
    share = F.broadcast(_local(spark, shares, "g string, source_size long, target double, passes int, rest long, bits int, k int"))
    of = sized.join(share, F.col("_source").eqNullSafe(F.col("g")), "left").drop("g")
    of = of.withColumns({"block": _bits(F.lit(0), F.col("bits")), "part": _bits(F.col("bits"), F.lit(10))})

    def ends(sums: DataFrame, level: str, rest: str) -> list:
        """Per source, the block (or part) in which the rest ends and what is left of the rest before it."""
        w = Window.partitionBy("_source").orderBy(level)
        run = sums.withColumn("upto", F.sum("s").over(w))
        return run.filter((F.col("upto") >= F.col(rest)) & (F.col("upto") - F.col("s") < F.col(rest))).select("_source", F.col(level), (F.col(rest) - F.col("upto") + F.col("s")).alias("left")).collect()

    first = ends(of.filter("rest > 0").groupBy("_source", "block", "rest").agg(F.sum("size").alias("s")), "block", "rest")
    edge = F.broadcast(_local(spark, first, "g string, edge int, edge_rest long"))
    of = of.join(edge, F.col("_source").eqNullSafe(F.col("g")), "left").drop("g")
    second = ends(of.filter("block = edge").groupBy("_source", "part", "edge_rest").agg(F.sum("size").alias("s")), "part", "edge_rest")
    inner = F.broadcast(_local(spark, second, "g string, edge_part int, part_rest long"))
    of = of.join(inner, F.col("_source").eqNullSafe(F.col("g")), "left").drop("g")

    reached = {r[0]: r[1] + 1 for r in first}
    quotas = np.array([(s[3] << s[5]) + reached.get(s[0], 0) for s in shares], dtype=np.int64)
    # the shard of each of a source's blocks, in the order in which they are dealt
    lists = spark.createDataFrame(runs(quotas, shards, seed)).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "shard"))).alias("x"))
    ranks = written(lists.select("k", F.flatten(F.transform("x", lambda r: F.array_repeat(r["shard"], (r["end"] - r["begin"]).cast("int")))).alias("dealt")), "dealt")
    of = of.join(near(ranks), "k", "left")

    inside = (F.col("block") == F.col("edge")) & (F.col("part") == F.col("edge_part"))
    whole = F.coalesce((F.col("block") < F.col("edge")) | ((F.col("block") == F.col("edge")) & (F.col("part") < F.col("edge_part"))), F.lit(False))
    tie = "doc_id" if "doc_id" in keep else "place"
    w = Window.partitionBy("_source").orderBy("place", tie, "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = of.filter(inside).withColumn("rest_taken", F.greatest(F.lit(0), F.least("size", F.col("part_rest") - F.coalesce(F.sum("size").over(w), F.lit(0)))))
    of = of.filter(~F.coalesce(inside, F.lit(False))).withColumn("rest_taken", F.when(whole, F.col("size")).otherwise(F.lit(0))).unionByName(cut)

    blocks = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))

    # block position of pass k: an odd multiple of the block number, so a permutation of all blocks, the source's own in each pass
    def copy(k: Column) -> Column:
        full = k < F.col("passes")
        drawn = F.xxhash64(F.lit(seed), F.col("_source"), k)
        odd = 2 * F.pmod(drawn, F.lit(1 << 20)) + 1
        turned = F.pmod(F.col("block") * odd + F.pmod(F.call_function("shiftright", drawn, F.lit(24)), blocks), blocks)
        shard = F.get("dealt", F.when(full, k * blocks + turned).otherwise(F.col("passes") * blocks + F.col("block")).cast("int"))
        return F.struct(k.alias("pass"), shard.alias("shard"), F.when(full, F.col("size")).otherwise(F.col("rest_taken")).alias("words"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.col("passes")), copy), lambda c: c["words"] > 0)
    return of.select(*keep, F.col("_source").alias("mix_source"), "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("rest_taken")).cast("long").alias("taken"), copies.alias("copies"), "place"), shards


def mix(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixture: docs' columns with mix_pass, mix_shard and mix_words, a row for each time a document is taken.

    Rows come partitioned by shard and in random (reproducible) order within it. A row of which fewer words
    than it has are taken keeps its text; mix_words says how many of its first words belong to the mixture.
    """
    planned, shards = plan(packed(docs, "doc_id", "text", "source"), shards, ("doc_id", "row"), seed)
    rows = planned.withColumn("c", F.explode("copies"))
    order = F.xxhash64("place", "c.pass")
    out = rows.select("row", F.col("c.pass").alias("_pass"), F.col("c.shard").alias("_shard"), F.col("c.words").alias("_words"), order.alias("_order"))
    dealt = out.repartitionById(shards, F.col("_shard")).sortWithinPartitions("_order")
    return unpacked(dealt, docs.columns, {}, {"mix_pass": F.col("_pass"), "mix_shard": F.col("_shard"), "mix_words": F.col("_words")})


def digest(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and the shards that get it."""
    return plan(docs, shards, ("doc_id",))[0].select("doc_id", "size", "source_size", "target", "taken", F.transform("copies", lambda c: c["shard"]).alias("shards"))
