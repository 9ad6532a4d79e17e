"""Subword-lattice language model: a unigram vocabulary weights every segmentation of a text.

The vocabulary is an existing public one (a SentencePiece file whose path is a parameter; never trained,
never copied). Its scores give the first weights: log probabilities are taken as they are, merge ranks of a
BPE vocabulary by Zipf's law. One expectation step over all distinct training words (forward-backward on
each word's lattice, weighted by the word's count) turns them into weights for this corpus. A text's score
is the log10 probability summed over all its segmentations: pieces do not cross words, so the forward
recursion runs word by word in log space and the words' sums add up, with one end-of-text piece.

Beside it stands a smoothed word-unigram base score. Counts of all training words are aggregated on the
executors; words that make up at least 1 / HEAD of all tokens are broadcast (by that definition never more
than HEAD of them), every other word of a text meets its count in a shuffled join.

Words are runs of anything but ASCII white space, A-Z lower-cased; a word's identity in the counts is a
64-bit hash. Defined cases: null and empty texts are just the end token; a null doc_id is in no fold and so
trains; repeated rows count and are scored once each; with no training text every c is 0, N and V are 0 and
the pieces keep their first weights; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import fold, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HEAD = 1 << 22
PIECE = 4 << 20  # bytes of text counted at once
FLUSH = 3_000_000  # distinct words a task holds before it hands them on
SPACE = "▁"
SPREAD = np.uint64(0xD6E8FEB86659FD93)
END = "</s>"


def vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Piece to natural-log weight, normalised; byte pieces are written <0xXX>."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
    ranked = any(s < -1000 for _, s in pieces)
    logs = {p: -math.log(10.0 - s) if ranked else s for p, s in pieces}
    total = math.log(sum(math.exp(v) for v in logs.values()))
    return {p: v - total for p, v in logs.items()}


class Lattice:
    """Forward and backward recursions over all segmentations, for many words of one length at a time."""

    def __init__(self, logs: dict[str, float]):
        self.pieces = [p for p in logs if not (len(p) == 6 and p.startswith("<0x"))]
        self.longest = max(map(len, self.pieces), default=1)
        self.bytes = np.array([logs.get(f"<0x{b:02X}>", -20.0) for b in range(256)])
        hashes = np.array([self._sums(np.array([[ord(c) for c in p]]))[0, -1] for p in self.pieces], dtype=np.uint64) * SPREAD
        order = np.argsort(hashes)
        self.keys, self.place = hashes[order], order
        self.values = np.array([logs[p] for p in self.pieces])[order]
        bucket = (self.keys >> np.uint64(47)).astype(np.int64)
        self.held = np.bincount(bucket, minlength=1 << 17).astype(np.uint8)
        self.begin = np.searchsorted(bucket, np.arange(1 << 17))

    @staticmethod
    def _sums(codes: np.ndarray) -> np.ndarray:
        up, _ = W.powers(W._WORD_BASE, codes.shape[1] + 1)
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: codes.shape[1]], axis=1, out=out[:, 1:])
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in keys, or -1."""
        bucket = (h >> np.uint64(47)).astype(np.int64)
        held, out = self.held[bucket], np.full(len(h), -1, dtype=np.int64)
        at, step = np.flatnonzero(held), 0
        while len(at):
            i = self.begin[bucket[at]] + step
            hit = self.keys[i] == h[at]
            out[at[hit]] = i[hit]
            step += 1
            at = at[~hit & (held[at] > step)]
        return out

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
        """found[w, j, k] and value[w, j, k] of the piece of k + 1 characters that ends at j + 1; weights of characters in no piece."""
        n, size = codes.shape
        sums = self._sums(codes)
        _, down = W.powers(W._WORD_BASE, size + 1)
        width = min(self.longest, size)
        found = np.full((n, size, width), -1, dtype=np.int32)
        for k in range(width):
            h = (sums[:, k + 1 :] - sums[:, : size - k]) * (down[: size - k] * SPREAD)
            found[:, k:, k] = self._find(h.ravel()).reshape(h.shape)
        value = np.where(found >= 0, self.values[found], -np.inf)
        odd = found[:, :, 0] < 0
        weights = {int(c): float(self.bytes[list(chr(int(c)).encode("utf-8", "surrogatepass"))].sum()) for c in np.unique(codes[odd])}
        if weights:
            keys = np.array(sorted(weights))
            value[:, :, 0][odd] = np.array([weights[int(c)] for c in keys])[np.searchsorted(keys, codes[odd])]
        return found, value, weights

    @staticmethod
    def _total(terms: np.ndarray) -> np.ndarray:
        top = terms.max(axis=1)
        top = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return top + np.log(np.exp(terms - top[:, None]).sum(axis=1))

    def _forward(self, value: np.ndarray) -> np.ndarray:
        n, size, width = value.shape
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0.0
        for j in range(size):
            k = min(width, j + 1)
            alpha[:, j + 1] = self._total(alpha[:, j - k + 1 : j + 1][:, ::-1] + value[:, j, :k])
        return alpha

    def _groups(self, data: bytes, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which words, their characters after the blank that opens each) by length; data holds the words end to end."""
        raw = np.frombuffer(data, dtype=np.uint8)
        codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        upto = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=upto[1:])
        end = upto[np.cumsum(sizes)]
        length = np.diff(end, prepend=0)
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            size = int(length[order[at]])
            to = min(int(np.searchsorted(length[order], size, side="right")), at + max(1, 400_000 // (size * min(size, self.longest) + 1)))
            which = order[at:to]
            out = np.full((len(which), size + 1), ord(SPACE), dtype=np.uint32)
            out[:, 1:] = codes[(end[which] - size)[:, None] + np.arange(size)]
            yield which, out
            at = to

    def log_probs(self, data: bytes, sizes: np.ndarray) -> np.ndarray:
        """Log probability of each word over all its segmentations."""
        out = np.zeros(len(sizes))
        for which, codes in self._groups(data, sizes):
            out[which] = self._forward(self._edges(codes)[1])[:, -1]
        return out

    def expect(self, data: bytes, sizes: np.ndarray, times: np.ndarray) -> dict[str, float]:
        """The expected number of each piece in `times` occurrences of each word."""
        totals = np.zeros(len(self.keys))
        rest: dict[int, float] = {}
        for which, codes in self._groups(data, sizes):
            found, value, odd = self._edges(codes)
            n, size, width = value.shape
            alpha = self._forward(value)
            beta = np.full((n, size + 1), -np.inf)
            beta[:, size] = np.log(times[which]) - alpha[:, size]
            for i in range(size - 1, -1, -1):
                ends = np.arange(i, min(size, i + width))
                beta[:, i] = self._total(beta[:, ends + 1] + value[:, ends, ends - i])
            back = np.arange(size)[:, None] - np.arange(width)
            share = np.exp(np.where(back >= 0, alpha[:, np.maximum(back, 0)], -np.inf) + value + beta[:, 1:, None])
            known = found >= 0
            totals += np.bincount(found[known], weights=share[known], minlength=len(totals))
            if odd:
                single = ~known[:, :, 0]
                for c, v in zip(codes[single], share[:, :, 0][single], strict=True):
                    rest[int(c)] = rest.get(int(c), 0.0) + v
        out = {self.pieces[p]: float(v) for p, v in zip(self.place, totals, strict=True) if v > 0}
        for c, v in rest.items():
            for b in chr(c).encode("utf-8", "surrogatepass"):
                out[f"<0x{b:02X}>"] = out.get(f"<0x{b:02X}>", 0.0) + v
        return out


def _taken(w: W.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some words end to end, and each one's size."""
    size = w.ends[which] - w.starts[which]
    ends = np.cumsum(size)
    return w.data[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(w.starts[which], size)], size


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, word, n): each distinct word of the task, as long as FLUSH of them can be held."""
    hashes: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    texts: list[pa.Array] = []

    def merged() -> tuple[np.ndarray, np.ndarray, pa.Array]:
        h, where, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        n = np.bincount(which, weights=np.concatenate(counts), minlength=len(h)).astype(np.int64)
        return h, n, pa.concat_arrays(texts).take(pa.array(where))

    def out() -> Iterator[pa.RecordBatch]:
        h, n, text = merged()
        for at in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[at : at + 100_000].view(np.int64)), "word": text[at : at + 100_000], "n": pa.array(n[at : at + 100_000])})

    for batch in batches:
        for _, data, offsets in W.pieces(batch, size=PIECE):
            w = W.scan(data, offsets, W.PLAIN, lower=True)
            if not len(w):
                continue
            h, where, n = np.unique(w.hashes(), return_index=True, return_counts=True)
            body, size = _taken(w, where)
            at = np.zeros(len(h) + 1, dtype=np.int32)
            at[1:] = np.cumsum(size)
            hashes.append(h)
            counts.append(n)
            texts.append(pa.StringArray.from_buffers(len(h), pa.py_buffer(at), pa.py_buffer(body)))
            if sum(map(len, hashes)) > FLUSH:
                h, n, text = merged()
                if len(h) > FLUSH // 2:
                    yield from out()
                    hashes, counts, texts = [], [], []
                else:
                    hashes, counts, texts = [h], [n], [text]
    if hashes:
        yield from out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, word, n) of every distinct word."""
    return texts.select("text").mapInArrow(_count, "h long, word string, n long").groupBy("h").agg(F.first("word").alias("word"), F.sum("n").alias("n"))


def _arrow_words(column: pa.Array) -> tuple[bytes, np.ndarray]:
    data, offsets = W.raw(column)
    return data.tobytes(), np.diff(offsets)


def _expect(lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, into = Lattice(lattice.value), {}
        for batch in batches:
            for piece, n in model.expect(*_arrow_words(batch.column("word")), batch.column("n").to_numpy().astype(float)).items():
                into[piece] = into.get(piece, 0.0) + n
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(into), pa.string()), "n": pa.array(list(into.values()), pa.float64())})

    return run


def _evaluate(lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lattice({p: v for p, v in lattice.value.items() if p != END})
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"h": batch.column("h"), "n": batch.column("n"), "log_p": pa.array(model.log_probs(*_arrow_words(batch.column("word"))))})

    return run


def fit(counts: DataFrame, texts: int, path: str = VOCABULARY) -> dict[str, float]:
    """The vocabulary's weights after one expectation step over the counted words; END has the share of `texts` ends."""
    start = vocabulary(path)
    shared = counts.sparkSession.sparkContext.broadcast(start)
    found = {r.piece: r.n for r in counts.select("word", "n").mapInArrow(_expect(shared), "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    total = sum(found.values())
    prior = max(1.0, 0.001 * total)  # the first weights count as so many pieces
    out = {p: (found.get(p, 0.0) + prior * math.exp(v)) / (total + prior) for p, v in start.items()}
    ends = (texts + 1.0) / (total + prior + texts + 1.0)
    return {p: math.log(v * (1.0 - ends)) for p, v in out.items()} | {END: math.log(ends)}


def _score(head, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs, known = head.value
        lattice = Lattice({p: v for p, v in model.value.items() if p != END})
        end = model.value[END]
        for batch in batches:
            for rows, data, offsets in W.pieces(batch, size=PIECE):
                w = W.scan(data, offsets, W.PLAIN, lower=True)
                h, n = w.hashes(), rows.num_rows
                distinct, where, which = np.unique(h, return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, distinct), max(0, len(keys) - 1))
                inside = (keys[at] == distinct) if len(keys) else np.zeros(len(distinct), dtype=bool)
                prob, log = np.zeros(len(distinct)), np.zeros(len(distinct))
                prob[inside], log[inside] = known[at[inside]], logs[at[inside]]
                if not inside.all():
                    body, size = _taken(w, where[~inside])
                    prob[~inside] = lattice.log_probs(body.tobytes(), size)
                score = np.bincount(w.row, weights=prob[which], minlength=n) + end
                near = log[which]
                common = inside[which]
                tail, row = h[~common], w.row[~common]
                order = np.lexsort((tail, row))
                tail, row = tail[order], row[order]
                new = np.ones(len(tail), dtype=bool)
                new[1:] = (tail[1:] != tail[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(tail)))
                begin = pa.array(np.searchsorted(row[first], np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": pa.array(w.counts + 1, pa.int64()),
                    "near": pa.array(np.bincount(w.row, weights=near, minlength=n), pa.float64()), "near_known": pa.array(np.bincount(w.row, weights=common, minlength=n).astype(np.int64)),
                    "score": pa.array(score / math.log(10), pa.float64()),
                    "tail": pa.ListArray.from_arrays(begin, pa.array(tail[first].view(np.int64))), "times": pa.ListArray.from_arrays(begin, pa.array(times.astype(np.int32))),
                })

    return run


def digest(docs: DataFrame, path: str = VOCABULARY, head_tokens: int = HEAD) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (fold(F.col("doc_id"), 10) == 0).alias("held_out"))
    taught = rows.filter(~F.col("held_out"))
    counts = written(word_counts(taught), "words")
    ends = taught.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, types = total.n + ends, total.v + (ends > 0)
    weights = fit(counts, ends, path)
    model = spark.sparkContext.broadcast(weights)
    frequent = counts.filter(F.col("n") * F.lit(head_tokens) >= F.lit(tokens)).select("h", "word", "n")
    top = frequent.mapInArrow(_evaluate(model), "h long, n long, log_p double").toPandas()
    keys = top["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    head = spark.sparkContext.broadcast((keys[order], np.log10(top["n"].to_numpy(dtype=float)[order] + 0.1), top["log_p"].to_numpy(dtype=float)[order]))
    schema = "doc_id long, held_out boolean, n_tokens long, near double, near_known long, score double, tail array<long>, times array<int>"
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = written(rows.mapInArrow(_score(head, model), schema).withColumn("rid", F.monotonically_increasing_id()), "scored")
    tail = scored.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("rid", F.col("x.tail").alias("h"), F.col("x.times").alias("times"))
    found = tail.join(counts.select("h", "n"), "h", "left").groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.1))).alias("far"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("far_known"),
    )
    zero = F.lit(0)
    end, below = math.log10(ends + 0.1), math.log10(tokens + 0.1 * (types + 1))
    return scored.drop("tail", "times").join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("near_known") + F.coalesce("far_known", zero) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("near") + F.coalesce("far", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score",
    )
