"""URL filters: rules first, then naive Bayes over the words of host and path.

Names are runs of letters in the lower-cased host and path (escapes decoded), and a run of digits is the name `0`. Concatenated
names are split into words by unigram Viterbi: a word counts with its frequency in the texts, and a run of letters that is
no word of at most WORD letters with 10 / (N 10**length), N being all words of the texts. Of equally likely splits the one with
the longer last word counts.

The classifier is multinomial naive Bayes with two classes, learned by expectation-maximisation: labelled examples (lists of
names, a parameter; one name is one example) give a first model, which judges every url there is; STEPS times the words of all
urls, by the probability so found, and those of the examples make the next model. Words that no example or url has had don't
count in a score. Rules say what is done with a place and not what words mean, so they teach nothing.

Urls are first reduced to shapes, the sorted names of a url with numbers alike; learning and scoring work on distinct shapes
with their number of urls. Every join on a name, a word, a substring or a shape goes through `spread`: what stands in 1/HEAVY of
the rows or more (at most HEAVY keys) is broadcast, all other keys are shuffled.

Defined cases: a null url, or one without `://`, has an empty host and path, no rule and no names, and gets the verdict of the
class prior; very long urls are read whole (letters of a run are cut every 255); of rules of equal length that fit, the first in
code-point order counts; a null or repeated page_id and repeated urls each give a row; without texts no name is split; an empty
table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (rule, verdict); a rule is a host and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labelled examples: names of hosts that are blocked and allowed.
BLOCKED = (
    "casino poker bingo jackpot slots roulette betting bets gambling lottery pills pharmacy viagra cialis steroids replica "
    "porn sex xxx adult cams escort hookup ads adserver advert banner popup doubleclick payday loans warez crack keygen torrent malware phishing spam scam"
).split()
ALLOWED = (
    "school university college library museum science research history journal archive encyclopedia dictionary government parliament court hospital "
    "weather garden kitchen recipes travel music theatre literature books mathematics physics biology chemistry geography language teacher student lecture"
).split()
PRIOR = 0.1  # of urls to be blocked, until some are judged
SMOOTH = 0.02  # added to the count of each word in each class
STEPS = 2
WORD = 24
HEAVY = 4096
NAMES = r"\p{L}{1,255}|\p{N}+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """A url's host in lower case and its path; empty where there is no `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # later ones win
        at, slash, begin = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + begin)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def names(host: Column, path: Column) -> Column:
    """The names of a url in order."""
    def found(text: Column) -> Column:
        return F.transform(F.regexp_extract_all(F.lower(text), F.lit(NAMES), F.lit(0)), lambda n: F.when(n.rlike(r"^\p{N}"), F.lit("0")).otherwise(n))

    return F.concat(found(host), found(F.coalesce(F.try_url_decode(path), path)))


def spread(left: DataFrame, right: DataFrame, key: str, heavy: int = HEAVY) -> DataFrame:
    """Inner join with right, whose key is unique; keys with 1/heavy of left's rows or more go by broadcast (both sides are written tables)."""
    uses = written(left.groupBy(key).agg(F.count("*").alias("_uses")), "uses")
    total = uses.agg(F.sum("_uses")).first()[0] or 0
    frequent = uses.filter(F.col("_uses") * heavy >= total).select(key)  # at most `heavy` keys
    common = right.join(F.broadcast(frequent), key, "left_semi")
    rest = left.join(F.broadcast(frequent), key, "left_anti").join(right, key)
    return left.join(F.broadcast(common), key).unionByName(rest)


def split(name: str, known: list[tuple[int, int, float]], log_total: float) -> list[str]:
    """The likeliest words of a name; known: (begin, end, log10 of the probability) of each word in it."""
    n = len(name)
    ends: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for begin, end, score in known:
        ends[end].append((begin, score))
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    unknown, since = -math.inf, 0  # of the splits whose last word is none, the best and where that begins
    for end in range(1, n + 1):
        fresh, grown = best[end - 1] - log_total, unknown - 1
        unknown, since = (grown, since) if grown >= fresh else (fresh, end - 1)
        best[end], back[end] = unknown, since
        for begin, score in ends[end]:
            if (best[begin] + score, -begin) > (best[end], -back[end]):
                best[end], back[end] = best[begin] + score, begin
    out = []
    while n:
        out.append(name[back[n] : n])
        n = back[n]
    return out[::-1]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the lower-cased letter runs of all whole texts that have at most WORD letters."""
    found = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return written(found.filter(F.length("word") <= WORD).groupBy("word").agg(F.count("*").alias("n")), "words")


def segmented(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct names (written) by the counts (written) of words."""
    total = max(1, counts.agg(F.sum("n")).first()[0] or 0)
    size = F.length("name")
    begins = distinct.filter("name <> '0'").select("name", F.explode(F.sequence(F.lit(1), size)).alias("b"))
    inner = begins.select("name", "b", F.explode(F.sequence(F.lit(1), F.least(F.lit(WORD), size - F.col("b") + 1))).alias("k"))
    parts = written(inner.select("name", (F.col("b") - 1).alias("begin"), (F.col("b") + F.col("k") - 1).alias("end"), F.col("name").substr(F.col("b"), F.col("k")).alias("word")), "substrings")
    # at most 255 * WORD words stand in a name
    found = spread(parts, counts, "word").groupBy("name").agg(F.collect_list(F.struct("begin", "end", F.log10(F.col("n") / total).alias("score"))).alias("known"))

    @F.pandas_udf("array<string>")
    def words(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([split(x, [(k["begin"], k["end"], k["score"]) for k in w] if w is not None else [], math.log10(total)) for x, w in zip(name, known, strict=True)])

    return written(distinct.join(found, "name", "left").select("name", words("name", "known").alias("words")), "split-names")


def _model(mass: DataFrame | None, examples: DataFrame, prior: float) -> tuple[DataFrame, float]:
    """(word, ratio) with the log of P(word | block) / P(word | allow), and the log odds of the classes."""
    every = examples if mass is None else mass.unionByName(examples)
    counts = written(every.groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "masses")
    v, block, allow = counts.agg(F.count("*"), F.sum("block"), F.sum("allow")).first()
    ratio = F.log((F.col("block") + SMOOTH) / (F.col("allow") + SMOOTH)) - math.log((block + SMOOTH * v) / (allow + SMOOTH * v))
    return written(counts.select("word", ratio.alias("ratio")), "ratios"), math.log(prior / (1 - prior))


def _scored(shapes: DataFrame, uses: DataFrame, words: DataFrame, model: DataFrame, odds: float) -> DataFrame:
    """(shape, n, odds) of shapes by the words of their names."""
    by_name = written(spread(words, model, "word").groupBy("name").agg(F.sum("ratio").alias("score")), "name-scores")
    sums = spread(uses, by_name, "name").groupBy("shape").agg(F.sum("score").alias("score"))
    return written(shapes.join(sums, "shape", "left").select("shape", "n", (F.coalesce("score", F.lit(0.0)) + odds).alias("odds")), "shape-scores")


def learned(shapes: DataFrame, split_names: DataFrame, blocked: Sequence[str], allowed: Sequence[str], steps: int = STEPS, prior: float = PRIOR) -> DataFrame:
    """(shape, n, odds): the log odds of block for each shape (shape, n, names; written)."""
    spark = shapes.sparkSession
    examples = spark.createDataFrame([(w, 1.0, 0.0) for w in blocked] + [(w, 0.0, 1.0) for w in allowed], "word string, block double, allow double")
    uses = written(shapes.select("shape", "n", F.explode("names").alias("name")), "names-of-shapes")
    words = written(split_names.select("name", F.explode("words").alias("word")), "words-of-names")
    model, odds = _model(None, examples, prior)
    scored = _scored(shapes, uses, words, model, odds)
    for _ in range(steps):
        p = 1 / (1 + F.exp(-F.col("odds")))
        judged = scored.select("shape", p.alias("p"))
        by_name = uses.join(judged, "shape").groupBy("name").agg(F.sum(F.col("n") * F.col("p")).alias("block"), F.sum(F.col("n") * (1 - F.col("p"))).alias("allow"))
        mass = spread(words, written(by_name, "name-masses"), "name").select("word", "block", "allow")
        sums = scored.agg(F.sum(F.col("n") * p), F.sum("n")).first()
        prior = (sums[0] + len(blocked)) / (sums[1] + len(blocked) + len(allowed)) if sums[1] else prior
        model, odds = _model(mass, examples, prior)
        scored = _scored(shapes, uses, words, model, odds)
    return scored


def judged(pages: DataFrame, texts: DataFrame, rules: Sequence[tuple[str, str]] = RULES, blocked: Sequence[str] = BLOCKED, allowed: Sequence[str] = ALLOWED, steps: int = STEPS) -> DataFrame:
    """page_id, host, path, rule, verdict and odds (the method's, whatever a rule says) of each row of pages."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    found = names(F.col("host"), F.col("path"))
    rows = written(rows.select("*", rule.alias("rule"), said.alias("said"), F.array_join(F.array_sort(found), " ").alias("shape")), "urls")
    shapes = written(rows.groupBy("shape").agg(F.count("*").alias("n")).withColumn("names", F.filter(F.split("shape", " "), lambda n: n != "")), "shapes")
    distinct = written(shapes.select(F.explode("names").alias("name")).distinct(), "names")
    odds = learned(shapes, segmented(distinct, word_counts(texts)), blocked, allowed, steps)
    met = spread(rows, odds.select("shape", "odds"), "shape")
    verdict = F.coalesce("said", F.when(F.col("odds") > 1e-9, F.lit("block")).otherwise(F.lit("allow")))
    return met.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "odds")


def digest(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the log odds of the method."""
    return judged(pages, documents)
