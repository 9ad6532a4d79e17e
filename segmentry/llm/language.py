"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1/-1 (seeded by its code point). A trigram's vector binds its
letters' vectors by elementwise product, each permuted (rotated) by its place; a text's vector bundles
its trigrams' by addition. A language's prototype bundles the training documents' vectors, each scaled to
its number of trigrams; prototypes are centred on their mean, which all languages share, and a document
goes to the prototype with the largest cosine.

Training is one pass: a task adds its documents into one vector a language, and those sums merge. What
reaches the driver is languages x DIM numbers, of at most MAX_LANGUAGES languages (ValueError beyond).

Letters are lower-cased Unicode letters; any run of others is one blank, and each text has a blank at
either end. Defined cases: a text that is null or has no letter is `und` with score 0; rows with a null
lang teach nothing; a null doc_id is in no fold and so is not held out; with nothing to learn from, every
document is `und`; very long texts are read whole, in blocks of bounded size; an empty table gives an empty result; ties go to the first language in code-point order; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from . import words as W

DIM = 1024
SEED = 20240607
CACHE = 40_000  # trigram vectors kept by a worker (1 kB each)
FLOOR = 0.1  # letters in no learned language, such as keys and encoded data, reach 0.09; clean texts of SHORT trigrams 0.14 and more
SHORT = 30
CELLS = 1 << 23  # numbers in a matrix of texts by trigrams (64 MB)
MAX_LANGUAGES = 2000  # prototypes on the driver (8 kB each)
_ALPHA = np.array([chr(i).isalpha() for i in range(0x10000)])
_VECTORS: dict[int, np.ndarray] = {}
_GRAMS: dict[int, np.ndarray] = {}


def _letter(code: int) -> np.ndarray:
    if code not in _VECTORS:
        if len(_VECTORS) > CACHE:
            _VECTORS.clear()
        _VECTORS[code] = np.random.default_rng([SEED, code]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1
    return _VECTORS[code]


def _gram(code: int) -> np.ndarray:
    if code not in _GRAMS:
        if len(_GRAMS) > CACHE:
            _GRAMS.clear()
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        _GRAMS[code] = np.roll(_letter(a), 2) * np.roll(_letter(b), 1) * _letter(c)
    return _GRAMS[code]


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes, the row of each, and whether each row has a letter."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer(" ".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(low) + 1), [1, *(len(t) + 1 for t in low)]) - 1  # a text's last blank is its own
    alpha = _ALPHA[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        alpha[i] = chr(int(codes[i])).isalpha()
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]  # the blank after a letter stays, others go
    lettered = np.zeros(len(low), dtype=bool)
    lettered[row[alpha]] = True
    s, r = np.where(alpha, codes, 0)[keep], row[keep]
    if not len(s):
        return s, r, lettered
    opens = np.ones(len(r), dtype=bool)  # a blank before each row's first letter
    opens[1:] = r[1:] != r[:-1]
    at = np.flatnonzero(opens)
    s, r = np.insert(s, at, 0), np.insert(r, at, r[at])
    if len(s) < 3:
        return s[:0], r[:0], lettered
    own = r[:-2] == r[2:]
    return (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[own], r[:-2][own], lettered


def _bundle(texts: list[str | None], key: np.ndarray | None = None, n_keys: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, or the sums over the texts of each key of vectors scaled by length; how many trigrams each text has, -1 without a letter."""
    grams, row, lettered = _trigrams(texts)
    size = n_keys if key is not None else len(texts)
    many = np.where(lettered, np.bincount(row, minlength=len(texts)), -1)
    if not len(grams):
        return np.zeros((size, DIM), dtype=np.float32), many
    distinct, which = np.unique(grams, return_inverse=True)
    if size * len(distinct) > CELLS and len(texts) > 1:  # many texts of ever new trigrams: by halves
        half = len(texts) // 2
        if key is None:
            return np.vstack([_bundle(texts[:half])[0], _bundle(texts[half:])[0]]), many
        return _bundle(texts[:half], key[:half], n_keys)[0] + _bundle(texts[half:], key[half:], n_keys)[0], many
    weight = None
    if key is not None:
        weight, row = (1.0 / np.bincount(row, minlength=len(texts)).clip(1))[row], key[row]
    out = np.zeros((size, DIM), dtype=np.float32)
    counts = np.bincount(row * len(distinct) + which, weights=weight, minlength=size * len(distinct)).reshape(size, -1).astype(np.float32)
    for at in range(0, len(distinct), 4096):
        out += counts[:, at : at + 4096] @ np.array([_gram(int(g)) for g in distinct[at : at + 4096]], dtype=np.float32)
    return out, many


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for rows, _, _ in W.pieces(batch, size=1 << 18):
            langs, key = np.unique(np.array(rows.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            got, _ = _bundle(rows.column("text").to_pylist(), key, len(langs))
            for lang, v in zip(langs, got.astype(np.float64), strict=True):
                sums[str(lang)] = sums[str(lang)] + v if str(lang) in sums else v
    yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "sums": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})


def prototypes(docs: DataFrame, held_out: str = "held_out") -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their unit vectors, learned from rows that are not held out."""
    taught = docs.filter(~F.col(held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    parts = taught.mapInArrow(_train, "lang string, sums array<double>")
    if taught.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("v")).collect()
    rows = sorted(rows, key=lambda r: r.lang.encode())
    if not rows:
        return [], np.zeros((0, DIM))
    p = np.array([[x.v for x in r.v] for r in rows])
    p /= np.linalg.norm(p, axis=1, keepdims=True).clip(1e-12)
    return [r.lang for r in rows], p


def _predict(model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, whole = model.value
        p = whole - whole.mean(axis=0) * (len(langs) > 1) if langs else whole
        whole, p = whole.astype(np.float32), (p / np.linalg.norm(p, axis=1, keepdims=True).clip(1e-12)).astype(np.float32)
        for batch in batches:
            for rows, _, _ in W.pieces(batch, size=1 << 18):
                v, many = _bundle(rows.column("text").to_pylist())
                lettered, fit = many >= 0, np.zeros(rows.num_rows)
                if langs:
                    v /= np.linalg.norm(v, axis=1, keepdims=True).clip(1e-9)
                    cosine, fit = v @ p.T, (v @ whole.T).max(axis=1)
                    best = cosine.argmax(axis=1)
                    score = np.where(lettered, cosine[np.arange(len(best)), best].clip(0, 1), 0.0)
                    said = [langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                else:
                    score, said = np.zeros(rows.num_rows), ["und"] * rows.num_rows
                yield pa.RecordBatch.from_pydict({c: rows.column(c) for c in columns} | {"lang_pred": pa.array(said, pa.string()), "score": pa.array(score.astype(np.float64)), "known": pa.array((fit >= FLOOR) | (many < SHORT))})

    return run


def identify(docs: DataFrame, keep: list[str], model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The columns `keep` of every document with lang_pred, score (cosine with the centred prototype, at least 0) and known.

    known: whether the text is in one of the languages at all: its cosine with a whole prototype reaches FLOOR, or it has
    fewer than SHORT trigrams, too few to tell.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double, known boolean"])
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(_predict(shared, keep), schema)


def with_folds(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", (fold(F.col("doc_id"), 3) == 1).alias("held_out"))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, known."""
    rows = with_folds(docs)
    return identify(rows, ["doc_id", "held_out"], prototypes(rows))
