"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes (a space and the text) in different places. The transducer reads both token rows at once:
its state is which side leads and the bytes by which it leads, the dangling suffix of that side's last token. The other side
gives the next token, which either leaves a shorter suffix, or ends level (the group closes), or passes it and leads itself.
Each token so taken overlaps the leader's last token, and no pair overlaps otherwise, so the steps are the links. Steps are
memoised by state and token.

A single space between two characters that are no white space is a cut for both tokenizers: the byte-level one never joins
what is before such a space with the space, and no piece of the other has its space mark anywhere but in front (checked when
it is loaded). The tokens of a text are therefore those of its stretches between such spaces, every group ends with its
stretch, and a worker keeps the tokens, groups and links of the stretches it meets again (CACHE of them; then those met only once go).

A pair's count is the number of documents that hold it linked. Documents are tokenised once; their distinct pairs are
written with their numbers of links, and counted by Spark. The most frequent pairs go to all workers: those of at least 2**j
documents, with the least j for which they are NEAR at most (16 MB); all other pairs meet their counts by a shuffled join,
in which no pair has 2**j rows.

Defined cases: a text that is null, empty, or not given back byte for byte by both tokenizers (one with U+2581 in it, say)
has no tokens: zeros and an empty groups_sha256; strings of special tokens are plain text; very long texts are read whole, a
million characters at a time (up to the next cut); rows of equal id are documents of their own and each counts; a null doc_id
stays; an empty table gives an empty result; ties for the most frequent pair of an id are all best; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import written

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Stretches, and steps of the transducer, kept by a worker (some 300 bytes each).
CACHE = 1 << 18
#: Characters of a text that are read at a time.
SLICE = 1 << 20
#: Pairs that every worker gets with their counts.
NEAR = 1 << 20
#: U+180E and U+200B are white space to some versions of Unicode; a cut is kept away from them.
CUT = re.compile(r"(?<=[^\s\u180e\u200b]) (?=[^\s\u180e\u200b])")
SIDE_A, SIDE_B = 0, 1
LEVEL = 0  # the state in which no side leads


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Transducer:
    """Aligns token rows of equal bytes; `bytes_of` has each side's bytes by id."""

    def __init__(self, bytes_of: tuple[list[bytes], list[bytes]]):
        self.bytes_of = bytes_of
        self.names = tuple([str(i) for i in range(len(side))] for side in bytes_of)
        self.forget()

    def forget(self) -> None:
        self.suffixes = [b""]
        self.leads = [SIDE_A]  # which side leads in a state
        self.number: dict[tuple[int, bytes], int] = {(SIDE_A, b""): LEVEL}
        self.steps: dict[int, int] = {}  # state << 32 | token: state after

    def _state(self, side: int, suffix: bytes) -> int:
        if not suffix:
            return LEVEL
        if (side, suffix) not in self.number:
            self.number[side, suffix] = len(self.suffixes)
            self.suffixes.append(suffix)
            self.leads.append(side)
        return self.number[side, suffix]

    def _step(self, state: int, token: int) -> int:
        """The state after the next token: of the side that trails, or of side A where none leads."""
        leader, suffix = self.leads[state], self.suffixes[state]
        taker = SIDE_A if state == LEVEL else 1 - leader
        new = self.bytes_of[taker][token]
        if len(new) > len(suffix):
            if not new.startswith(suffix):
                raise ValueError("the two sides have different bytes")
            after = self._state(taker, new[len(suffix) :])
        else:
            if not suffix.startswith(new):
                raise ValueError("the two sides have different bytes")
            after = self._state(leader, suffix[len(new) :])
        self.steps[state << 32 | token] = after
        return after

    def align(self, a: list[int], b: list[int], links: list[int]) -> list[str]:
        """The groups of two rows of tokens, each as its ids `a1,a2|b1`; the pairs of ids that overlap are added to links (A's in the high 32 bits)."""
        if len(self.steps) > CACHE:
            self.forget()
        steps, leads, (name_a, name_b), n = self.steps, self.leads, self.names, len(a)
        groups, state, i, j = [], LEVEL, 0, 0
        while True:
            if state == LEVEL:
                if i == n:
                    break
                token, from_i, from_j = a[i], i, j
                i += 1
            elif leads[state] == SIDE_A:
                token = b[j]
                links.append(a[i - 1] << 32 | token)
                j += 1
            else:
                token = a[i]
                links.append(token << 32 | b[j - 1])
                i += 1
            after = steps.get(state << 32 | token)
            state = self._step(state, token) if after is None else after
            if state == LEVEL:
                if i - from_i == 1 and j - from_j == 1:
                    groups.append(name_a[a[from_i]] + "|" + name_b[b[from_j]])
                else:
                    groups.append(",".join([name_a[x] for x in a[from_i:i]]) + "|" + ",".join([name_b[x] for x in b[from_j:j]]))
        if j < len(b):
            raise ValueError("the two sides have different bytes")
        return groups


class Aligner:
    """Both tokenizers and what is known of the stretches met so far."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        with open(byte_level, encoding="utf-8") as f:
            special = {t["id"]: t["content"] for t in json.load(f)["added_tokens"]}
        letters, entries = byte_letters(), [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        of_a = [special[i].encode() if i in special else bytes(letters[c] for c in e) for i, e in enumerate(entries)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        of_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece has a space mark after another character")
        self.transducer = Transducer((of_a, of_b))
        self.number: dict[str, int] = {}
        self.counts, self.texts, self.links = array("q"), [], array("q")
        self.again = bytearray()
        self._frozen: tuple[np.ndarray, np.ndarray] | None = None

    def _shrink(self) -> None:
        """Forgets all stretches but those met again since they were learned (or since the last time), half of CACHE at most."""
        *_, n_links, begin = self.columns()
        links = self.all_links()
        kept = [(s, k) for s, k in self.number.items() if self.again[k]][: CACHE // 2]
        at = np.array([k for _, k in kept], dtype=np.int64)
        counts = np.frombuffer(self.counts, dtype=np.int64).reshape(-1, 5)[at]
        self.links = array("q", b"".join(links[begin[k] : begin[k] + n_links[k]].tobytes() for k in at))
        self.counts, self.texts = array("q", counts.tobytes()), [self.texts[k] for k in at]
        self.number, self.again, self._frozen = {s: i for i, (s, _) in enumerate(kept)}, bytearray(len(kept)), None

    def learn(self, stretches: set[str]) -> None:
        """Tokens, groups and links of stretches (without the space before them) that aren't known."""
        if len(self.number) > CACHE:
            self._shrink()
        new, of_a, number, again, align = [], self.transducer.bytes_of[SIDE_A], self.number, self.again, self.transducer.align
        for s in stretches:
            k = number.get(s)
            if k is None:
                new.append(s)
            else:
                again[k] = 1
        if not new:
            return
        self._frozen = None
        whole = [" " + s for s in new]
        for s, text, e, b in zip(new, whole, self.a.encode_batch_fast(whole, add_special_tokens=False), self.b.encode(new, num_threads=1), strict=True):
            a, links = e.ids, []
            try:
                groups = align(a, b, links) if b"".join([of_a[t] for t in a]) == text.encode() else None
            except (IndexError, ValueError):  # B's bytes are others
                groups = None
            if groups is None:
                groups, links = [], []
            number[s] = len(self.texts)
            self.texts.append(";".join(groups))
            self.counts.extend((bool(groups), len(a), len(b), len(groups), len(links)))
            self.links.extend(links)
        again.extend(bytes(len(new)))

    def columns(self) -> list[np.ndarray]:
        """valid, n_a, n_b, n_groups, n_links by stretch, then where its links begin."""
        if self._frozen is None:
            found = np.array(self.counts, dtype=np.int64).reshape(-1, 5).T.copy()
            self._frozen = np.vstack([found, np.cumsum(found[4]) - found[4]]), np.array(self.links, dtype=np.int64)
        return list(self._frozen[0])

    def all_links(self) -> np.ndarray:
        self.columns()
        return self._frozen[1]


@lru_cache(maxsize=2)
def aligner(byte_level: str, pieces: str) -> Aligner:
    return Aligner(byte_level, pieces)


def slices(text: str) -> Iterator[list[str]]:
    """The stretches of a text, those of about SLICE characters at a time."""
    at = 0
    while at < len(text):
        cut = CUT.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = cut.start() if cut else len(text)
        yield CUT.split(text[at:end])
        at = end + 1


class _Document:
    """What is known of a document after some of its slices."""

    def __init__(self) -> None:
        self.ok, self.counts, self.groups, self.begun = True, np.zeros(4, dtype=np.int64), hashlib.sha256(), False
        self.pairs, self.times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, known: Aligner, stretches: list[str]) -> None:
        ids = np.fromiter(map(known.number.__getitem__, stretches), dtype=np.int64, count=len(stretches))
        valid, *sums, begin = known.columns()
        links = known.all_links()
        if not self.ok or not valid[ids].all():
            self.ok = False
            return
        self.counts += [c[ids].sum() for c in sums]
        self.groups.update(((";" if self.begun else "") + ";".join(map(known.texts.__getitem__, ids.tolist()))).encode())
        self.begun = True
        n = sums[3][ids]
        pairs, times = np.unique(links[np.repeat(begin[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())], return_counts=True)
        if len(self.pairs):
            both, where = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
            times = np.bincount(where, weights=np.concatenate([self.times, times])).astype(np.int64)
            pairs = both
        self.pairs, self.times = pairs, times

    def row(self) -> tuple:
        if not self.ok or not self.begun:
            return 0, 0, 0, 0, "", [], []
        return *(int(c) for c in self.counts), self.groups.hexdigest(), self.pairs, self.times


_SHAPE = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
])


def _aligned(byte_level: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(byte_level, pieces)
        for batch in batches:
            for rows, _, _ in W.pieces(batch):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                short = [CUT.split(t) if len(t) <= SLICE else None for t in texts]
                known.learn(set().union(*(s for s, t in zip(short, texts, strict=True) if s and t)))
                out = []
                for text, stretches in zip(texts, short, strict=True):
                    doc = _Document()
                    if stretches is None:
                        for part in slices(text):
                            known.learn(set(part))
                            doc.add(known, part)
                    elif text:
                        if len(texts) > 1 and any(s is None for s in short):
                            known.learn(set(stretches))  # a long text may have made the worker start anew
                        doc.add(known, stretches)
                    out.append(doc.row())
                columns = [pa.array(c, type=_SHAPE.field(i + 2).type) for i, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), *columns], schema=_SHAPE)

    return run


def aligned(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Per document: row (unique), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, its distinct linked pairs (A id in the high 32 bits) and how many links each has."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_aligned(byte_level, pieces), "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): the number of documents of `aligned` that hold a pair, and whether none of the same A id has more."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of a vocabulary
    return counts.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _level(counts: DataFrame, limit: int) -> int:
    """The least j such that at most `limit` pairs have a count of 2**j or more."""
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("j")).count().collect()  # a row for each power of two
    j, sum_ = max((r.j for r in levels), default=0) + 1, 0
    for r in sorted(levels, key=lambda r: -r.j):
        sum_ += r["count"]
        if sum_ > limit:
            break
        j = r.j
    return j


def _looked_up(shared, rest: bool):
    """Sums over the pairs that are near, or (rest) the links of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times")
            p, t = lists.flatten().to_numpy(), times.flatten().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(pair, p), max(0, len(pair) - 1))
            hit = pair[at] == p if len(pair) else np.zeros(len(p), dtype=bool)
            if rest:
                yield pa.RecordBatch.from_pydict({"row": pa.array(batch.column("row").to_numpy()[of[~hit]]), "pair": pa.array(p[~hit]), "times": pa.array(t[~hit])})
                continue
            bests, sums = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            if hit.any():
                np.add.at(bests, of[hit], t[hit] * best[at[hit]])
                np.add.at(sums, of[hit], t[hit] * n[at[hit]])
            columns = {c: batch.column(c) for c in batch.schema.names if c not in ("pairs", "times")}
            yield pa.RecordBatch.from_pydict(columns | {"n_best": pa.array(bests), "count_sum": pa.array(sums)})

    return run


def scored(rows: DataFrame, counts: DataFrame, near: int = NEAR) -> DataFrame:
    """`aligned`'s rows (written) with n_best and count_sum by the counts (written) of their pairs."""
    j = _level(counts, near)
    frequent = counts.filter(F.col("n") >= 1 << j).orderBy("pair").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(tuple(frequent.column(c).to_numpy() for c in ("pair", "n", "best")))
    plain = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    part = rows.mapInArrow(_looked_up(shared, False), ", ".join([*(f"{c} {kinds[c]}" for c in plain), "n_best long", "count_sum long"]))
    others = rows.select("row", "pairs", "times").mapInArrow(_looked_up(shared, True), "row long, pair long, times long")
    met = others.join(counts.filter(F.col("n") < 1 << j), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    both = part.join(met, "row", "left")
    return both.select(*plain, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))


def digest(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, near: int = NEAR) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = written(aligned(docs, byte_level, pieces), "aligned")
    counts = written(pair_counts(rows), "pairs")
    return scored(rows, counts, near).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
