"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Normalisation lower-cases A-Z and takes runs of ASCII letters, digits and non-ASCII characters as
words. An item's windows are its runs of `n` consecutive words; an item with fewer words (but not
none) is one window. The windows' hashes are broadcast; training texts are scanned with the same
rolling hash, and each hit is verified word by word before it counts.

The broadcast is bounded: benchmark items are dealt into blocks of about `block_bytes` of text, and each block is one more
narrow pass over the documents, without a shuffle. CHAIN passes run in one worker, a piece of text after the other; what they found is
then written, with the texts, before the next ones, so a task has one worker with CHAIN blocks at most, whatever the benchmark's
size. The hit words are cut out in the worker of the last pass. A block is arrays: the items' bytes, where their words begin and end, and windows in order of hash; about five times its
text, on the driver and in a worker.

Defined cases: a null or empty text has no words and no hits; very long texts are scanned whole; a null item text has no windows; a null
item_id counts as the empty id; repeated document rows each get their own result row; repeated items
(same id) count once; an empty table of documents gives an empty result, and an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import beside, text_changed, unpacked, written

N = 10
BLOCK_BYTES = 8 << 20
CHAIN = 4
Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_HITS = "n_words long, spans array<int>, items array<string>"


class Index:
    """Windows of `n` words of the items, a shorter item whole: by length of window, hashes in order and where each begins."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        data, offsets = W.raw(pa.array([text for _, text in items], pa.string()))
        w = W.scan(data, offsets, W.ALNUM, lower=True)
        self.items = [item for item, _ in items]
        self.data, self.starts, self.ends, self.row = w.data, w.starts, w.ends, w.row.astype(np.int32)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        h = w.hashes()
        sums = W.span_sums(h)
        for size in np.unique(np.minimum(w.counts[w.counts > 0], n)).tolist():
            g = W.kgrams(h, size, sums)
            # of a full window's length all windows count, of a shorter one those that are whole items
            at = np.flatnonzero(w.same_row(size) & (w.counts[w.row[: len(g)]] >= n if size == n else w.counts[w.row[: len(g)]] == size))
            order = np.argsort(g[at], kind="stable")
            self.windows[size] = (g[at][order], at[order].astype(np.int32))

    def words(self, at: int, size: int) -> list[bytes]:
        return [self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(at, at + size)]

    def of(self, size: int, h: np.uint64, words: list[bytes]) -> set[str]:
        """The items that have this window, verified word by word."""
        hashes, places = self.windows[size]
        a, b = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
        return {self.items[self.row[at]] for at in places[a:b].tolist() if self.words(at, size) == words}


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _scanner(index, columns: list[str], keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        for batch in batches:
            for rows, data, offsets in W.pieces(batch):
                w = W.scan(data, offsets, W.ALNUM, lower=True)
                h = w.hashes()
                sums = W.span_sums(h)
                spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
                items: dict[int, set[str]] = defaultdict(set)
                known: dict[tuple[int, bytes], set[str]] = {}
                for size, (hashes, _) in block.windows.items():
                    g = W.kgrams(h, size, sums)
                    if not len(g):
                        continue
                    at = np.minimum(np.searchsorted(hashes, g), len(hashes) - 1)
                    for i in np.flatnonzero((hashes[at] == g) & w.same_row(size)).tolist():
                        words = [w.word(j) for j in range(i, i + size)]
                        key = (size, b" ".join(words))
                        if key not in known:
                            known[key] = block.of(size, g[i], words)
                        if known[key]:
                            r = int(w.row[i])
                            first = int(i - w.first[r])
                            spans[r].append((first, first + size))
                            items[r] |= known[key]
                had = rows.column("spans").to_pylist() if "spans" in rows.schema.names else [None] * rows.num_rows
                listed = rows.column("items").to_pylist() if "items" in rows.schema.names else [None] * rows.num_rows
                out = {c: rows.column(c) for c in columns}
                if keep_text:
                    out["text"] = rows.column("text")
                out["n_words"] = pa.array(w.counts, pa.int64())
                out["spans"] = pa.array([_merge(spans.get(r, []) + list(zip(s[::2], s[1::2], strict=True)) if s else spans.get(r, [])) for r, s in enumerate(had)], pa.list_(pa.int32()))
                out["items"] = pa.array([sorted(items.get(r, set()) | set(s or ())) for r, s in enumerate(listed)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_pydict(out)

    return run


def _after(passes: list[Pass]) -> Pass:
    """The passes one after the other in one worker: each worker has its own interpreter and libraries, some 100 MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for each in passes:
            batches = each(batches)
        yield from batches

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int = N, block_bytes: int = BLOCK_BYTES, then: Pass | None = None) -> DataFrame:
    """The columns `keep` of each document with n_words, spans (word ranges [s, e, s, e, ...] that are hit) and items.

    then: what the last worker does with the rows, whose columns stay.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("body")).filter("body IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("body") + F.octet_length("item") + 64)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    out = docs.select(*keep, *([] if "text" in keep else ["text"]))
    carried = [c for c in keep if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    passes: list[Pass] = []
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(Index([(r.item, r.body) for r in part.toLocalIterator()], n))
        last = b == blocks - 1
        text = "text" in keep or not last
        passes.append(_scanner(index, carried, text))
        if last or (b + 1) % CHAIN == 0:
            schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), *(["text string"] if text else []), _HITS])
            out, passes = out.mapInArrow(_after([*passes, then] if last and then else passes), schema), []
            out = out if last else written(out, "hits")
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in W.pieces(batch):
            w = W.scan(data, offsets, W.ALNUM)
            texts = rows.column("text").to_pylist()
            for r, spans in enumerate(rows.column("spans").to_pylist()):
                if not spans:
                    continue
                body, base, at, parts = texts[r].encode(), int(offsets[r]), 0, []
                for s, e in zip(spans[::2], spans[1::2], strict=True):
                    parts.append(body[at : int(w.starts[w.first[r] + s]) - base])
                    at = int(w.ends[w.first[r] + e - 1]) - base
                texts[r] = b"".join([*parts, body[at:]]).decode()
            yield rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: str = "spans", n: int = N) -> DataFrame:
    """docs without what occurs in the benchmark: the hit words ("spans") or whole documents ("documents").

    Other columns stay as they are; n_chars, where there is one, follows the text.
    """
    if how == "documents":
        hits = benchmark_hits(beside(docs), benchmark, ["text", "row"], n)
        return unpacked(hits.filter(F.size("spans") == 0), docs.columns, {"text": F.col("text")})
    hits = benchmark_hits(beside(docs), benchmark, ["text", "row"], n, then=_cut)
    return unpacked(hits, docs.columns, text_changed(F.col("text"), docs.columns))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = benchmark_hits(docs, benchmark, ["doc_id"])
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return hits.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
