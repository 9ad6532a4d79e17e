"""The fences of quality rules and their verdicts against brute force."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from segmentry.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RATES = {"symbol_rate": (1, 0), "dup_rate": (3, 2), "repeat_rate": (4, 0)}


def prose(rng, n, symbols=0.0, lines=0.0):
    """n words in lines of about eight; a share of words with a symbol, a share of lines that stand twice."""
    words = [f"{'abcdefghij'[: rng.randrange(1, 10)]}{rng.randrange(900)}" + ("#" if rng.random() < symbols else "") for _ in range(n)]
    text = [" ".join(words[i : i + 8]) for i in range(0, n, 8)]
    return "\n".join(x for line in text for x in ([line, line] if rng.random() < lines else [line]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for group in (("en", "a"), ("en", None), ("de", "a"), (None, "b")):
        # texts of one group are longer, of another full of symbols, and one group is small
        for _ in range({"de": 30}.get(group[0], 120)):
            n = rng.randrange(10, 400) * (5 if group[1] is None else 1)
            out.append((prose(rng, n, 0.2 * rng.random() if group[0] is None else (0.9 if rng.random() < 0.06 else 0), rng.choice([0, 0, 0.1])), *group))
    out += [(None, "en", "a"), ("", "fr", "z"), ("few words", None, None)]
    return [(i, t, lang, source, 0) for i, (t, lang, source) in enumerate(out)]


def counted(text):
    """n_words, n_symbols, n_lines, n_dup_lines, n_repeat_words and the words' lengths."""
    words, lines = (text or "").split(), [x for x in (text or "").split("\n") if x.split()]
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    again = {i + d for places in at.values() if len(places) > 1 for i in places for d in range(5)}
    return len(words), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(again), [len(w) for w in words]


def quartiles(values):
    values, n = sorted(values), len(values)
    error = math.sqrt(0.1875 / n) + 2.296 / 400**0.9723
    low, high = max(0, math.floor((0.25 - error) * 400)) / 400, min(400, math.ceil((0.75 + error) * 400)) / 400
    return [values[max(0, math.ceil(round(p * n, 9)) - 1)] for p in (low, high)]


def test_fences_and_verdicts_match_brute_force(spark, rows):
    counts = {i: counted(t) for i, t, *_ in rows}
    failed = {i: c[0] < 10 or 100 * c[4] > 20 * c[0] for i, c in counts.items()}
    good = [r for r in rows if not failed[r[0]]]
    fences, kept = {}, {}
    for group in {r[2:4] for r in good}:
        for members in ([r for r in good if r[2:4] == group], [r for r in good if r[2] == group[0]], good):
            if len(members) >= 100:
                break
        of = [counts[r[0]] for r in members]
        q1, q3 = quartiles([statistics.mean(c[5]) for c in of])
        limits = {"word_len_low": q1 - 6 * (q3 - q1), "word_len_high": q3 + 6 * (q3 - q1)}
        for rate, (s, m) in RATES.items():
            q1, q3 = quartiles([math.sqrt((c[s] + 0.375) / (c[m] + 1)) for c in of])
            limits[f"{rate}_high"] = (q3 + 6 * (q3 - q1)) ** 2
        fences[group] = limits
    for i, _, *group, _ in rows:
        c, limits = counts[i], fences.get(tuple(group))
        kept[i] = not failed[i]
        if kept[i]:
            mean, room = statistics.mean(c[5]), 2 * statistics.pstdev(c[5]) / math.sqrt(c[0])
            kept[i] = limits["word_len_low"] <= mean + room and mean - room <= limits["word_len_high"] and all((math.sqrt(c[s] + 0.375) - 1) / math.sqrt(c[m] + 1) <= math.sqrt(limits[f"{rate}_high"]) for rate, (s, m) in RATES.items())
    got = quality.quality(spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(1)).withColumn("u", F.lit("x"))).collect()
    assert {r.doc_id: r.kept for r in got} == kept and len(got) == len(rows)
    for r in got:
        if (r.lang, r.source) in fences:
            assert {c: r[c] for c in fences[r.lang, r.source]} == pytest.approx(fences[r.lang, r.source], rel=1e-9)
    rejected = sum(not k for i, k in kept.items() if not failed[i])
    assert 0 < rejected < len(rows) / 3


def test_groups_have_fences_of_their_own(spark, rows):
    """What is common in one group is odd in another; one cutoff for all would give other verdicts."""
    limits = {(r.g_lang, r.g_source): r for r in quality.thresholds(quality._rates(quality.text_counts(spark.createDataFrame(rows, SCHEMA), ["doc_id", "lang", "source"]))).collect()}
    assert limits[None, "b"].symbol_rate_high > 2 * limits["en", "a"].symbol_rate_high > 3 * limits["en", None].symbol_rate_high
    assert limits["de", "a"].symbol_rate_high not in (limits["en", "a"].symbol_rate_high, limits["en", None].symbol_rate_high)


def test_short_texts_with_one_symbol_and_long_ones_stay(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(50, 900)), "en", "a", 0) for i in range(300)]
    rows += [(900, prose(rng, 11) + " #", "en", "a", 0), (901, prose(rng, 200_000), "en", "a", 0), (902, prose(rng, 300, symbols=0.9), "en", "a", 0)]
    kept = {r.doc_id: r.kept for r in quality.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept[900] and kept[901] and not kept[902] and sum(not k for k in kept.values()) <= 4


def test_empty_and_equal_rows(spark):
    assert quality.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "the same ten words stand in each row of it"
    got = quality.digest(spark.createDataFrame([(1, text, None, "a", 0)] * 5 + [(None, text, None, "a", 0)], SCHEMA)).collect()
    assert len(got) == 6 and all(r.kept for r in got)
