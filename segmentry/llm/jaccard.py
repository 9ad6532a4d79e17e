"""N-gram Jaccard join: exact components of documents whose shingle sets overlap enough, by T-occurrence search.

A pair with 100 * |x & y| >= 85 * |x | y| shares at least T = ceil(0.85 |x|) of x's shingles. DivideSkip merges x's
short inverted lists and probes its L long ones; with L = T - 1 a partner must stand in at least T - L = 1 of the
|x| - T + 1 short lists. Which lists are short is settled on all documents:

1.  Documents with equal sets are one class, by two 64-bit sums over the set; only its smallest id goes on.
2.  A document with |x| - T + 1 shingles that no other document has can have no partner. Shingles in a fixed share of the
    hash space (`MEASURED` times that of the short lists) are counted first, which drops most documents; then all shingles of those that stay, twice,
    as those that dropped no longer count. What stays shares nearly all its shingles with others that stay.
3.  Each of these merges its shortest lists, |x| - T + 1 of them less its own shingles. All documents order shingles
    alike (by length of list, then hash), so no link is lost. A pair that meets there must also pass the length filter
    and a distance bound: shingles of its own each count against a document, and so does each of 256 parity bits (flipped by
    the shared shingles that hash to it) in which the two differ. Both lose no link.
4.  A list first meets in its most typical member (fewest shingles of its own), then in 16, 256, ... of its members at
    random, each time only with members of other components; it closes when it lies in one component or all its
    members have been centres. So a group of near copies costs a few comparisons a member, and pairs inside a component are
    never formed. What is left to compare is what no filter can tell apart from links.
5.  Candidates of one centre go in blocks of at most `BLOCK` with one copy of the centre's set each. A block is a
    T-occurrence search: inverted lists over its sets, the centre's short ones merged by a heap, the documents that reach T - L
    probed in the long ones by binary search, the exact overlap deciding.

No list is cut. Words are runs of anything but ASCII white space, A-Z lower-cased; shingles are 4 words by 64-bit hash,
and a shorter text's whole sequence is its only one.

Defined cases: null and empty texts have no shingles, link with nothing and are components of their own; rows
that repeat an id (or have none) are documents of their own, in order of text; equal rows link (if they have words); very long
texts are hashed whole, and memory follows the longest; an empty table gives an empty result; other columns are ignored
(and kept by `deduplicate`).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .common import keyed, near, packed, scratch, unkeyed, written
from .components import components

K = 4
PERCENT = 85
#: Share of the hash space that is counted first, as a multiple of the share of short lists.
MEASURED = 1.5
#: Candidates of a centre that are searched at a time.
BLOCK = 1000
#: Centres of a list grow by this factor a round.
GROW = 16
#: 64-bit words of a set's parity.
PARITY = 4
_BITS = [f"p{i}" for i in range(PARITY)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = K) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (63 bits) of each row."""
    w = W.scan(data, offsets, W.PLAIN, lower=True)
    h = w.hashes()
    sums = W.span_sums(h)
    g = W.kgrams(h, k, sums) >> np.uint64(1)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            keep = np.ones(len(s), dtype=bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(W.span_hash(sums, np.array([a]), np.array([b])) >> np.uint64(1))
        else:
            out.append(h[:0])
    return out


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _sets(k: int, bound: int | None):
    """Of each row: size of its set, two sums over it, and its shingles (those below `bound`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in W.pieces(batch):
                sets = shingle_sets(data, offsets, k)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                whole = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                ends = np.cumsum(n)
                out = {"rid": rows.column("rid"), "n": pa.array(n)}
                if bound is not None:
                    one, two = np.zeros(len(whole) + 1, np.uint64), np.zeros(len(whole) + 1, np.uint64)
                    np.cumsum(W.mix(whole), out=one[1:])
                    np.cumsum(W.mix(whole ^ np.uint64(0x5555AAAA5555AAAA)), out=two[1:])
                    out |= {"one": pa.array((one[ends] - one[ends - n]).view(np.int64)), "two": pa.array((two[ends] - two[ends - n]).view(np.int64))}
                    low = whole < np.uint64(bound)
                    below = np.append(0, np.cumsum(low))
                    whole, n = whole[low], below[ends] - below[ends - n]
                begin = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                yield pa.RecordBatch.from_pydict(out | {"shingles": pa.ListArray.from_arrays(begin, pa.array(whole.view(np.int64)))})

    return run


def t_occurrence(query: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Exact overlaps of the query with those sets that reach the threshold, 0 for others: DivideSkip over these sets' inverted lists."""
    least = max(1, least_overlap(len(query), percent))
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    begin, end = np.searchsorted(tokens, query), np.searchsorted(tokens, query, side="right")
    length = end - begin
    by_length = np.argsort(length, kind="stable")
    # long lists: as many as balance probing against merging, T - 1 at most
    n_long = min(least - 1, int(least / (0.01 * np.log2(int(length.max(initial=0)) + 1) + 1)))
    short, long = by_length[: len(query) - n_long], by_length[len(query) - n_long :]
    probe = query[long]
    out = np.zeros(len(sets), dtype=np.int64)

    def settle(i: int, n: int) -> None:
        if n >= least - n_long:
            s = sets[i]
            n += int((s[np.minimum(np.searchsorted(s, probe), len(s) - 1)] == probe).sum())
            if 100 * n >= percent * (len(query) + len(s) - n):
                out[i] = n

    at, n = -1, 0
    for i in heapq.merge(*(owner[begin[j] : end[j]].tolist() for j in short if length[j])):
        if i != at:
            if n:
                settle(at, n)
            at, n = i, 0
        n += 1
    if n:
        settle(at, n)
    return out


def _search(percent: int):
    """Links of each centre with the members of its block; a block's first row is the centre."""

    def links(centre: int, query: np.ndarray, ids: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
        got = np.flatnonzero(t_occurrence(query, sets, percent)) if sets else []
        return [centre] * len(got), [ids[i] for i in got]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, query, ids, sets = None, None, [], []
        for batch in batches:
            us, vs = [], []
            flat = batch.column("shingles")
            at = flat.offsets.to_numpy()
            values = flat.values.to_numpy().view(np.uint64)
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                mine = values[at[i] : at[i + 1]]
                if b is None:
                    if sets:
                        u, v = links(centre, query, ids, sets)
                        us, vs = us + u, vs + v
                    centre, query, ids, sets = a, mine.copy(), [], []
                else:
                    ids.append(b)
                    sets.append(mine.copy())
            yield pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})
        u, v = links(centre, query, ids, sets) if sets else ([], [])
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of those pairs (a, b) that link, given the sets (rid, shingles) of both."""
    blocks = near(written(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("of")), "blocks"))
    member = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("of")).cast("int")).drop("of")
    member = member.join(sets.withColumnRenamed("rid", "b"), "b").select("a", "block", "b", "shingles")
    centre = sets.withColumnRenamed("rid", "a").join(blocks, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "shingles")
    dealt = centre.unionByName(member).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(_search(percent), "u long, v long")


def _alone(rows: DataFrame) -> DataFrame:
    """(rid, alone): how many of the rows (rid, s) no other document has, where there are any."""
    own = rows.groupBy("s").agg(F.count("*").alias("c"), F.min("rid").alias("rid")).filter("c = 1")
    return own.groupBy("rid").agg(F.count("*").alias("alone"))


def _reach(percent: int) -> Column:
    """How many shingles of its own rule out any partner: n - T + 1."""
    return F.col("n") - F.ceil(F.col("n") * percent / 100) + 1


def _crowded(rows: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """(rid, n) of the rows with fewer shingles of their own (in lists: rid, s) than rule out any partner."""
    return rows.select("rid", "n").join(_alone(lists), "rid", "left").filter(F.coalesce("alone", F.lit(0)) < _reach(percent)).select("rid", "n")


def _short_lists(sets: DataFrame, percent: int) -> DataFrame:
    """(s, rid, n, alone, parity) of each document's short lists, from (rid, n, shingles)."""
    rows = sets.select("rid", "n", F.explode("shingles").alias("s"))
    shared = rows.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright("s", 6).bitwiseAND(F.lit(PARITY - 1))
    bits = [F.coalesce(F.expr("bit_xor(_bit) FILTER (WHERE _word = %d)" % i), F.lit(0).cast("long")).alias(c) for i, c in enumerate(_BITS)]
    mine = rows.join(shared, "s").withColumn("_bit", bit).withColumn("_word", word).groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("lists"), *bits)
    ranked = mine.withColumn("alone", F.col("n") - F.size("lists")).filter(F.col("alone") < _reach(percent))
    return ranked.select("rid", "n", "alone", *_BITS, F.explode(F.slice("lists.s", 1, (_reach(percent) - F.col("alone")).cast("int"))).alias("s"))


_ROW = ["n", "alone", *_BITS]


def _may_link(percent: int) -> Column:
    """The length filter and the distance bound on a row and another's columns, which end in _a."""
    x, y = F.col("n"), F.col("n_a")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_a"))) for c in _BITS), F.col("alone") + F.col("alone_a"))
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & ((100 + percent) * apart <= (100 - percent) * (x + y))


def _forest(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, component) of documents that link, from their short lists; None where there is none."""
    labelled, seen, forest, turn = lists.withColumn("c", F.col("rid")), None, None, 0
    while True:
        # lists that still lie in several components, and whose members have not all been centres
        size = labelled.groupBy("s").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("k")).filter("c0 <> c1").select("s", "k")
        if turn > 1:
            size = size.filter(F.col("k") > GROW ** (turn - 1))
        opened = written(labelled.join(size, "s"), "lists")
        if not opened.limit(1).count():
            return forest
        if turn == 0:
            typical = F.min(F.struct(F.col("alone") / F.col("n"), "rid", "c", *_ROW))
            centres = opened.groupBy("s").agg(typical.alias("x")).select("s", "x.rid", "x.c", *(F.col(f"x.{c}").alias(c) for c in _ROW))
        else:
            spot = F.pmod(F.xxhash64("rid", "s"), F.lit(1 << 40))
            centres = opened.filter((F.col("k") <= GROW**turn) | (spot < F.floor(F.lit(float(GROW**turn << 40)) / F.col("k")))).drop("k")
        centres = centres.select("s", F.col("rid").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ["c", *_ROW]))
        met = opened.join(centres, "s").filter((F.col("c") != F.col("c_a")) & _may_link(percent))
        # a pair goes by its centre at first; then the smaller id stands for it, as both may be centres
        pairs = met.select("a", F.col("rid").alias("b")) if turn == 0 else met.select(F.least("a", "rid").alias("a"), F.greatest("a", "rid").alias("b"))
        pairs = written(pairs.distinct(), "pairs")
        if seen is not None:
            pairs = pairs.join(seen, (F.least(pairs.a, pairs.b) == F.col("x")) & (F.greatest(pairs.a, pairs.b) == F.col("y")), "left_anti")
        done = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        seen = done if seen is None else seen.unionByName(done)
        links = written(_links(pairs, sets, percent), "links")
        if links.limit(1).count():
            if forest is not None:
                links = links.unionByName(forest.select(F.col("node").alias("u"), F.col("component").alias("v")).filter("u <> v"))
            forest = components(links)
            label = opened.drop("c", "k").join(near(forest.withColumnRenamed("node", "rid")), "rid", "left")
            labelled = label.withColumn("c", F.coalesce("component", "rid")).drop("component")
        else:
            labelled = opened.drop("k")
        turn += 1


def classes(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(rid, n_shingles, component) for docs (rid, text), as a written table."""
    with scratch() as result:
        sets = written(docs.mapInArrow(_sets(k, int(min(1.0, MEASURED * (1 - percent / 100)) * ((1 << 63) - 1))), "rid long, n long, one long, two long, shingles array<long>"), "sets")
        some = sets.filter("n > 0")
        first = some.groupBy("one", "two", "n").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
        copies = some.select("rid", "one", "two", "n").join(near(written(first, "first")), ["one", "two", "n"]).filter("rid <> rep").select("rid", "rep")
        copies = written(copies, "copies")
        reps = some.join(near(copies.select("rid")), "rid", "left_anti").select("rid", "n", "shingles")
        rows = written(_crowded(reps, reps.select("rid", F.explode("shingles").alias("s")), percent), "crowded")
        full = written(docs.join(near(rows.select("rid")), "rid", "left_semi").mapInArrow(_sets(k, None), "rid long, n long, shingles array<long>"), "full")
        rows = written(_crowded(rows, full.select("rid", F.explode("shingles").alias("s")), percent), "crowded")
        full = written(full.join(near(rows.select("rid")), "rid", "left_semi"), "full")
        lists = written(_short_lists(full, percent), "lists")
        forest = _forest(lists, full.select("rid", "shingles"), percent)
        out = sets.select("rid", F.col("n").alias("n_shingles")).join(near(copies), "rid", "left").withColumn("node", F.coalesce("rep", "rid"))
        if forest is None:
            return result(out.select("rid", "n_shingles", F.col("node").alias("component")), "classes")
        return result(out.join(near(forest), "node", "left").select("rid", "n_shingles", F.coalesce("component", "node").alias("component")), "classes")


def digest(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    rows, back = keyed(docs)
    found = classes(rows, k, percent).withColumnRenamed("component", "component_id")
    return unkeyed(found, back, also=("component_id",))


def deduplicate(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: the one with the smallest id (of rows that repeat an id, the first by text)."""
    rows, back = keyed(docs)
    gone = classes(rows, k, percent).filter("rid <> component").select("rid")
    if back is None:
        return docs.alias("d").join(near(gone.withColumnRenamed("rid", "_gone")).alias("g"), F.col("d.doc_id") == F.col("g._gone"), "left_anti")
    # repeated ids: rows keep their own text, and of equal rows one stays
    stay = rows.join(back, "rid").join(gone, "rid", "left_anti").select(F.col("id").alias("_id"), F.col("text").alias("_text"))
    mine = packed(docs, "doc_id", "text").join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text").eqNullSafe(F.col("_text")), "left_semi")
    one = Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(F.to_json("row")))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return mine.withColumn("rank", F.row_number().over(one)).filter((F.col("rank") == 1) | wordless).select("row.*")
