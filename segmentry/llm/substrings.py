"""Substring dedup: suffix automata of reference shards give matching statistics; long matches are removed.

`remove_reference` is the plain form: reference texts are cut into shards of bounded size, each shard's suffix
automaton is broadcast, and documents stream through one shard after the other.

`repeated_spans` finds what a corpus repeats of itself. The reference is then the corpus, so shards are made
by content and documents are routed to the shards that can match, instead of every shard to every document:

1.  Every window of `min_words` words has an anchor, the least hash among its 6-word grams; windows side by side with
    the same anchor form a run. Equal windows have equal anchors, so a repeat shows up among runs of one anchor.
    Anchors are counted with partial sums; only runs whose anchor stands twice or more go on.
2.  Equal runs (by a 64-bit hash of their words, within the anchor) collapse into the first of them: all their later
    occurrences lie in earlier text as a whole.
3.  An anchor with different runs is a reference shard: its runs, in order of their first place, stream through the
    suffix automaton of those before them, which gives their matching statistics; windows that a match
    of `min_words` covers are repeats. An anchor with more than MAX_RUNS different runs (a frequent phrase in ever new
    surroundings) is no shard for one task: its runs are taken apart into windows, whose first places are grouped
    minima with partial sums, so nothing grows with a group of copies or with a frequent phrase.
4.  Spans are merged by document and cut out of the text.

A word is a run of anything but ASCII white space. Earlier means: smaller doc_id, or the same document and an
earlier word. Windows are judged on the input.

Defined cases: null and empty texts have no words; texts shorter than a window repeat nothing; rows that share a
doc_id (or have none) count as documents of their own in order of text, and equal rows as one; an empty table gives an
empty result; other columns are ignored (and kept by `deduplicate`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .automaton import SuffixAutomaton
from .common import keyed, semi, unkeyed, written

MIN_WORDS = 20
GRAM = 6
MAX_RUNS = 2000
SHARD_WORDS = 500_000
_RUN = "anchor long, run long, rid long, start int, windows int"


def _anchors(min_words: int):
    gram = min(GRAM, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in W.pieces(batch):
                w = W.scan(data, offsets)
                own = w.same_row(min_words)
                if not own.any():
                    continue
                sums = W.span_sums(w.hashes())
                g = W.kgrams(w.hashes(), gram, sums)
                _, at = W.sliding_min(g, min_words - gram + 1)
                at = np.where(own, at, -1)
                opens = np.ones(len(at), dtype=bool)
                opens[1:] = at[1:] != at[:-1]
                first = np.flatnonzero(opens)
                end = np.append(first[1:], len(at))
                real = at[first] >= 0
                first, end = first[real], end[real]
                anchor = at[first]
                content = W.span_hash(sums, first, end + min_words - 1) + (anchor - first).astype(np.uint64)
                row = w.row[first]
                yield pa.RecordBatch.from_pydict({
                    "anchor": pa.array(g[anchor].view(np.int64)), "run": pa.array(W.mix(content).view(np.int64)),
                    "rid": rows.column("rid").take(pa.array(row)), "start": pa.array((first - w.first[row]).astype(np.int32)),
                    "windows": pa.array((end - first).astype(np.int32)),
                })

    return run


def _take(min_words: int):
    """Word hashes of the wanted runs, each for the shard of its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in W.pieces(batch):
                w = W.scan(data, offsets)
                h = w.hashes()
                shard, rid, start, parts = [], [], [], []
                rids = rows.column("rid").to_pylist()
                for r, wanted in enumerate(rows.column("wanted").to_pylist()):
                    for x in wanted:
                        at = int(w.first[r]) + x["start"]
                        shard.append(x["anchor"])
                        rid.append(rids[r])
                        start.append(x["start"])
                        parts.append(h[at : at + x["windows"] + min_words - 1])
                begin = pa.array(np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32))
                flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int64()), "rid": pa.array(rid, pa.int64()), "start": pa.array(start, pa.int32()), "seq": pa.ListArray.from_arrays(begin, pa.array(flat.view(np.int64)))})

    return run


def _windows(min_words: int):
    """(window, rid, start): each window of the wanted runs, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in W.pieces(batch):
                w = W.scan(data, offsets)
                sums = W.span_sums(w.hashes())
                wanted = rows.column("wanted").to_pylist()
                at = np.concatenate([np.arange(x["start"], x["start"] + x["windows"]) + w.first[r] for r, xs in enumerate(wanted) for x in xs])
                row = w.row[at]
                yield pa.RecordBatch.from_pydict({"window": pa.array(W.span_hash(sums, at, at + min_words).view(np.int64)), "rid": rows.column("rid").take(pa.array(row)), "start": pa.array((at - w.first[row]).astype(np.int32))})

    return run


def runs_of(matching: list[int], least: int) -> list[tuple[int, int]]:
    """(first window, how many) of the windows of `least` words that the matching statistics cover."""
    out: list[tuple[int, int]] = []
    for end in range(least - 1, len(matching)):
        if matching[end] >= least:
            at = end - least + 1
            if out and out[-1][0] + out[-1][1] == at:
                out[-1] = (out[-1][0], out[-1][1] + 1)
            else:
                out.append((at, 1))
    return out


def _match(min_words: int):
    """Streams each shard's sequences, in order, through the automaton of those before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, automaton, waiting = None, SuffixAutomaton(), None
        for batch in batches:
            rid, start, windows = [], [], []
            for shard, r, s, seq in zip(*(batch.column(c).to_pylist() for c in ("shard", "rid", "start", "seq")), strict=True):
                if shard != current:
                    current, automaton, waiting = shard, SuffixAutomaton(), None
                if waiting is not None:
                    automaton.add(waiting)
                    for at, n in runs_of(automaton.matching(seq), min_words):
                        rid.append(r)
                        start.append(s + at)
                        windows.append(n)
                waiting = seq
            yield pa.RecordBatch.from_pydict({"rid": pa.array(rid, pa.int64()), "start": pa.array(start, pa.int32()), "windows": pa.array(windows, pa.int32())})

    return run


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, max_runs: int = MAX_RUNS) -> DataFrame:
    """(rid, start, windows): runs of windows of docs (rid, text) that also start earlier."""
    docs = docs.select("rid", "text").filter("rid IS NOT NULL")
    runs = docs.mapInArrow(_anchors(min_words), _RUN)
    twice = runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    found = written(runs.join(twice, "anchor"), "runs")
    first = found.groupBy("anchor", "run").agg(F.min(F.struct("rid", "start", "windows")).alias("first"), F.count("*").alias("copies"))
    first = written(first, "first")
    later = found.join(first.filter("copies > 1").select("anchor", "run", F.col("first.rid").alias("r"), F.col("first.start").alias("s")), ["anchor", "run"])
    later = later.filter("rid <> r OR start <> s").select("rid", "start", "windows")
    mixed = first.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    of_run = F.struct(F.col("first.start").alias("start"), F.col("first.windows").alias("windows"), "anchor")

    def wanted(kinds: DataFrame) -> DataFrame:
        return first.join(kinds, "anchor").select(F.col("first.rid").alias("rid"), of_run.alias("x")).groupBy("rid").agg(F.collect_list("x").alias("wanted"))

    taken = docs.join(wanted(mixed.filter(F.col("kinds") <= max_runs)), "rid").select("rid", "text", "wanted")
    sequences = taken.mapInArrow(_take(min_words), "shard long, rid long, start int, seq array<long>")
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = sequences.repartition(parts, "shard").sortWithinPartitions("shard", "rid", "start")
    spans = later.unionByName(ordered.mapInArrow(_match(min_words), "rid long, start int, windows int"))
    large = mixed.filter(F.col("kinds") > max_runs)
    if large.limit(1).count():
        many = written(wanted(large), "many")
        each = written(semi(docs, many.select("rid"), ["rid"]).join(many, "rid").mapInArrow(_windows(min_words), "window long, rid long, start int"), "windows")
        early = each.groupBy("window").agg(F.min(F.struct("rid", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        again = each.join(early, "window").filter("rid <> first.rid OR start <> first.start")
        spans = spans.unionByName(again.select("rid", "start", F.lit(1).alias("windows")))
    return spans


def merged(spans: list[dict], min_words: int) -> list[tuple[int, int]]:
    """Word ranges that runs of windows cover, in order, disjoint."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["start"] + x["windows"] + min_words - 1) for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _cut(min_words: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in W.pieces(batch):
                w = W.scan(data, offsets)
                removed, digests, texts = [], [], []
                for r, spans in enumerate(rows.column("spans").to_pylist()):
                    words = data[offsets[r] : offsets[r + 1]].tobytes().split()
                    gone = 0
                    for s, e in reversed(merged(spans, min_words) if spans else []):
                        del words[s:e]
                        gone += e - s
                    text = b" ".join(words)
                    removed.append(gone)
                    if keep_text:
                        texts.append(text.decode())
                    else:
                        digests.append(hashlib.sha256(text).hexdigest())
                out = {"rid": rows.column("rid"), "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
                yield pa.RecordBatch.from_pydict(out | ({"kept": pa.array(texts, pa.string())} if keep_text else {"kept_sha256": pa.array(digests, pa.string())}))

    return run


def _cleaned(rows: DataFrame, min_words: int, keep_text: bool) -> DataFrame:
    rows = rows.filter("rid IS NOT NULL")
    spans = repeated_spans(rows, min_words).groupBy("rid").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    schema = "rid long, n_words long, n_removed long, " + ("kept string" if keep_text else "kept_sha256 string")
    return rows.join(spans, "rid", "left").select("rid", "text", "spans").mapInArrow(_cut(min_words, keep_text), schema)


def digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    rows, back = keyed(docs)
    return unkeyed(_cleaned(rows, min_words, False), back)


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words that stay, joined by blanks)."""
    rows, back = keyed(docs)
    return unkeyed(_cleaned(rows, min_words, True), back)


def _stream(shard, columns: list[str], min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for sequence in shard.value:
            automaton.add(sequence)
        for batch in batches:
            for rows, data, offsets in W.pieces(batch):
                w = W.scan(data, offsets)
                h = w.hashes().view(np.int64)
                spans = rows.column("spans").to_pylist()
                for r in range(rows.num_rows):
                    found = runs_of(automaton.matching(h[w.first[r] : w.first[r + 1]].tolist()), min_words)
                    spans[r] = (spans[r] or []) + [{"start": s, "windows": n} for s, n in found]
                yield pa.RecordBatch.from_pydict({c: rows.column(c) for c in columns} | {"spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int32())])))})

    return run


def _shards(reference: DataFrame, shard_words: int) -> Iterator[list[list[int]]]:
    """The reference's word hashes, at most shard_words at a time (a longer text is a shard of its own)."""
    held: list[list[int]] = []
    for r in reference.select("text").filter("text IS NOT NULL").toLocalIterator():
        data, offsets = W.raw(pa.array([r.text], pa.string()))
        sequence = W.scan(data, offsets).hashes().view(np.int64).tolist()
        if held and sum(map(len, held)) + len(sequence) > shard_words:
            yield held
            held = []
        held.append(sequence)
    if held:
        yield held


def remove_reference(docs: DataFrame, reference: DataFrame, min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept: docs without the spans of min_words or more words that a reference text holds."""
    out = docs.select(F.col("doc_id").cast("long").alias("rid"), "text", F.lit(None).cast("array<struct<start:int,windows:int>>").alias("spans"))
    for sequences in _shards(reference, shard_words):
        shard = docs.sparkSession.sparkContext.broadcast(sequences)
        out = out.mapInArrow(_stream(shard, ["rid", "text"], min_words), "rid long, text string, spans array<struct<start:int,windows:int>>")
    return out.mapInArrow(_cut(min_words, True), "rid long, n_words long, n_removed long, kept string").withColumnRenamed("rid", "doc_id")
