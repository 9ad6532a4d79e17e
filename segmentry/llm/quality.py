"""Quality rules: thresholds learned for each language and source from mergeable quantile sketches.

Base features are counted in one vectorised pass. For each (lang, source) KLL sketches of four features are aggregated
on the executors (partial sketches merge, so a hot source costs no more than its rows); sketches of small groups are
merged upward, into their language's and then into the whole table's. A group's fence is its upper quartile plus `spread`
interquartile ranges; mean word length also has a lower fence. Nothing else bounds a rate:

*   Rates of symbols, repeated lines and repeated words are 0 in most texts, and quartiles of 0 say nothing. The sketches see
    sqrt((s + 3/8) / (m + 1)) for a count s of m, where counts spread about alike whatever their mean: a group's fence follows
    how long its texts are and how often its members do repeat.
*   Mean word length is sketched as it is. A text is beyond a fence if it is so by more than `ERRORS` of its own standard
    errors: of its mean, or 1/2 for the root of a count. So a clean short text isn't odd for being short or for one symbol.
*   Quartiles are read at 1/4 - e and 3/4 + e, where e is the standard error of a group's rank plus the rank error of the
    sketch. Fences of small groups are wider for it, those of large groups need no other allowance.

Defined cases: a null or empty text has zero counts and fails the base rule; null lang or source form
groups of their own (null-safe join); groups below `min_group` rows use the next larger sketch; repeated
rows each get a result row; very long texts are counted whole, and memory follows the longest; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import small, written

_COUNTS = "n_words long, word_chars long, word_squares double, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_NEWLINE = W.separator_table(b"\n")

#: rate -> what is counted, and of how many.
RATES = {"symbol_rate": ("n_symbols", "n_words"), "dup_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words")}
FEATURES = ["word_len", *RATES]
SPREAD = 6.0
ERRORS = 2.0
MIN_GROUP = 100
SKETCH_K = 400


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return np.diff(sums[offsets])


def _covered(windows: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in one of the marked windows of k words."""
    edge = np.zeros(len(windows) + k, dtype=np.int64)
    at = np.flatnonzero(windows)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return np.cumsum(edge)[:-1] > 0


def _repeats(w: W.Words, h: np.ndarray, k: int) -> np.ndarray:
    """Per row, words in k-word windows that stand twice or more in the row."""
    g = W.kgrams(h, k)
    own = w.same_row(k)
    if not own.any():
        return np.zeros(len(w.counts), dtype=np.int64)
    g = W.mix(g + w.row[: len(g)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    s = np.sort(g[own])
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(w.counts), dtype=np.int64)
    at = np.minimum(np.searchsorted(twice, g), len(twice) - 1)
    return _per_row(_covered((twice[at] == g) & own, k), w.first)


def _count(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in W.pieces(batch):
                w = W.scan(data, offsets)
                inside = W.PLAIN[data]
                letter = inside & ((data & 0xC0) != 0x80)
                upto = np.zeros(len(data) + 1, dtype=np.int64)
                np.cumsum(letter, out=upto[1:])
                length = (upto[w.ends] - upto[w.starts]).astype(float)
                lines = W.Words(data, offsets, _NEWLINE)
                filled = np.zeros(len(data) + 1, dtype=np.int64)
                np.cumsum(inside, out=filled[1:])
                real = filled[lines.ends] > filled[lines.starts]
                key, row = lines.hashes()[real], lines.row[real]
                order = np.lexsort((key, row))
                again = np.zeros(len(order), dtype=bool)
                again[1:] = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
                n = len(offsets) - 1
                out = {c: rows.column(c) for c in columns}
                out |= {
                    "n_words": pa.array(w.counts, pa.int64()),
                    "word_chars": pa.array(_per_row(letter, offsets), pa.int64()),
                    "word_squares": pa.array(np.bincount(w.row, weights=length**2, minlength=n), pa.float64()),
                    "n_symbols": pa.array(_per_row(_SYMBOLS[data], offsets), pa.int64()),
                    "n_lines": pa.array(np.bincount(row, minlength=n), pa.int64()),
                    "n_dup_lines": pa.array(np.bincount(row[order][again], minlength=n), pa.int64()),
                    "n_repeat_words": pa.array(_repeats(w, w.hashes(), 5), pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(out)

    return run


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` with n_words, word_chars, word_squares (of the words' lengths), n_symbols, n_lines, n_dup_lines, n_repeat_words of each text."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*keep, "text").mapInArrow(_count(keep), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), _COUNTS]))


def _rates(counts: DataFrame) -> DataFrame:
    """The counts with word_len, its standard error, the rates and base_failed."""
    words, mean = F.greatest(F.col("n_words"), F.lit(1)), F.col("word_len")
    rates = {rate: F.col(s) / F.greatest(F.col(m), F.lit(1)) for rate, (s, m) in RATES.items()}
    return counts.withColumns({
        "word_len": F.col("word_chars") / words, **rates,
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    }).withColumn("word_len_error", F.sqrt(F.greatest(F.col("word_squares") / words - mean * mean, F.lit(0.0)) / words))


def _sketched(feature: str) -> Column:
    """What the sketches see of a feature."""
    if feature not in RATES:
        return F.col(feature)
    s, m = RATES[feature]
    return F.sqrt((F.col(s) + 0.375) / (F.col(m) + 1))


def thresholds(rates: DataFrame, min_group: int = MIN_GROUP, spread: float = SPREAD) -> DataFrame:
    """Per g_lang, g_source: word_len_low and <feature>_high. The sketches see the rows that pass the base rule."""
    group = rates.filter("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(_sketched(c), F.lit(SKETCH_K)).alias(c) for c in FEATURES))
    group = written(group, "sketches")
    merge = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(c).alias(c) for c in FEATURES)]
    by_lang = group.groupBy(F.col("lang").alias("l_lang")).agg(*merge).select("l_lang", F.struct("n", *FEATURES).alias("of_lang"))
    whole = group.agg(*merge).select(F.struct("n", *FEATURES)).scalar()
    joined = group.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang"))).select("lang", "source", F.struct("n", *FEATURES).alias("own"), "of_lang", whole.alias("of_all"))
    used = joined.select("lang", "source", F.when(F.col("own.n") >= min_group, F.col("own")).when(F.col("of_lang.n") >= min_group, F.col("of_lang")).otherwise(F.col("of_all")).alias("u"))
    # rank error of a sketch of k: that of its single-sided normalized bound
    error = F.sqrt(F.lit(0.1875) / F.col("u.n")) + 2.296 / SKETCH_K**0.9723
    out = [F.col("lang").alias("g_lang"), F.col("source").alias("g_source")]
    for c in FEATURES:
        # a sketch is asked for fixed ranks: all steps of 1 / k, and the steps next to the quartiles, outward, are picked
        steps = F.kll_sketch_get_quantile_double(F.col(f"u.{c}"), F.array(*(F.lit(i / SKETCH_K) for i in range(SKETCH_K + 1))))
        q1 = F.get(steps, F.greatest(F.lit(0), F.floor((0.25 - error) * SKETCH_K)).cast("int"))
        q3 = F.get(steps, F.least(F.lit(SKETCH_K), F.ceil((0.75 + error) * SKETCH_K)).cast("int"))
        high = q3 + spread * (q3 - q1)
        out += [(high * high).alias(f"{c}_high")] if c in RATES else [(q1 - spread * (q3 - q1)).alias(f"{c}_low"), high.alias(f"{c}_high")]
    return used.select(*out)


def _beyond() -> Column:
    """Whether a row lies beyond a fence of its group."""
    room = ERRORS * F.col("word_len_error")
    out = (F.col("word_len") - room > F.col("word_len_high")) | (F.col("word_len") + room < F.col("word_len_low"))
    for rate, (s, m) in RATES.items():
        out = out | ((F.sqrt(F.col(s) + 0.375) - ERRORS / 2) / F.sqrt(F.col(m) + 1) > F.sqrt(F.col(f"{rate}_high")))
    return out


def quality(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: its counts, rates, base_failed, the fences of its group, and kept: whether it passes the base rule and every fence.

    A group without a row that passes the base rule has no fences; its rows all fail the base rule anyway.
    """
    rates = _rates(written(text_counts(docs, [key, "lang", "source"]), "counts"))
    limits = thresholds(rates)
    near = F.broadcast(limits) if small(limits, 100_000) else limits
    joined = rates.join(near, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(_beyond(), F.lit(False)))


def digest(docs: DataFrame) -> DataFrame:
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source", "word_len", "symbol_rate", "dup_rate", "repeat_rate")
