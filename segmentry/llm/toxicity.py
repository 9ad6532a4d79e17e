"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents that the labels confirm as toxic; the training documents as a whole are the unlabelled
text, whatever they hold. A linear model over hashed word and word-prefix presence is trained with the
class-prior-corrected risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)):  where the second part falls
below zero, its gradient is followed upward instead, so the model cannot win by fitting the unlabelled
documents as negatives. The prior is the share of toxic rows among the training labels.

Feature statistics cover every training document: tasks count presence by bucket, the counts merge, and
buckets whose count among positives is off what the whole suggests by a Poisson likelihood ratio of at least
MIN_RATIO (the best MAX_FEATURES of them) form the model. All confirmed documents count as positives there.
Only the fit takes about MAX_POSITIVE confirmed and about MAX_UNLABELLED unlabelled documents, chosen by a
hash of the id; both bounds are parameters.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Defined cases: null and empty
texts have no feature and get the model's bias; a null doc_id is in no fold, so it is not held out; several
labels of one document confirm it if one does; without a confirmed example every score is the prior (0
without labels); repeated rows each get a row; labels, lang, source and the id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import BROADCAST_ROWS, fold

BITS = 18
PREFIXES = (6, 8)
MAX_FEATURES = 4096
MIN_RATIO = 30.0
MAX_POSITIVE = 30_000
MAX_UNLABELLED = 60_000


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word and of the PREFIXES (in bytes) of longer words, once a row."""
    w = W.scan(data, offsets, W.ALNUM, lower=True)
    shift = np.uint64(64 - BITS)
    words = (w.hashes() >> shift).astype(np.int64)
    found = [w.row << BITS | words]
    for size in PREFIXES:
        long = w.ends - w.starts > size
        begin = w.starts[long]
        packed = np.full(len(begin), size, dtype=np.uint64)
        for i in range(size):
            packed = packed * np.uint64(0x100000001B3) + w.data[begin + i]
        found.append(w.row[long] << BITS | (W.mix(packed) >> shift).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & (1 << BITS) - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, u, texts = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64), np.zeros(2, dtype=np.int64)
    for batch in batches:
        for rows, data, offsets in W.pieces(batch):
            row, bucket = features(data, offsets)
            confirmed = rows.column("confirmed").to_numpy(zero_copy_only=False)
            u += np.bincount(bucket, minlength=1 << BITS)
            p += np.bincount(bucket[confirmed[row]], minlength=1 << BITS)
            texts += (confirmed.sum(), len(confirmed))
    at = np.flatnonzero(u)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(at, -1)), "p": pa.array(np.append(p[at], texts[0])), "u": pa.array(np.append(u[at], texts[1]))})


def _present(chosen, columns: list[str], model=None):
    """Rows with their chosen features (numbers within the choice), or with the model's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << BITS, -1, dtype=np.int64)
        number[chosen.value] = np.arange(len(chosen.value))
        for batch in batches:
            for rows, data, offsets in W.pieces(batch):
                row, bucket = features(data, offsets)
                n = number[bucket]
                row, n = row[n >= 0], n[n >= 0]
                out = {c: rows.column(c) for c in columns}
                if model is None:
                    out["feats"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32)), pa.array(n.astype(np.int32)))
                else:
                    weights, bias = model.value
                    out["score"] = pa.array(sigmoid(np.bincount(row, weights=weights[n], minlength=rows.num_rows) + bias))
                yield pa.RecordBatch.from_pydict(out)

    return run


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def nnpu(row: np.ndarray, feat: np.ndarray, confirmed: np.ndarray, marginal: np.ndarray, n_features: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with the logistic loss (Adam, full batch).

    row, feat: the present features; confirmed, marginal: for each row, whether it is among the positives and
    among the sample of all text (a row may be both).
    """
    n = len(confirmed)
    n_p, n_u = max(1, confirmed.sum()), max(1, marginal.sum())
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=theta[feat], minlength=n) + theta[-1]
        s = sigmoid(z)
        as_negative = np.logaddexp(0, z)
        negative = as_negative[marginal].sum() / n_u - prior * as_negative[confirmed].sum() / n_p
        up = confirmed * prior * (s - 1) / n_p
        down = marginal * s / n_u - confirmed * prior * s / n_p
        slope = up + down if negative >= 0 else -down
        g = np.append(np.bincount(feat, weights=slope[row], minlength=n_features), slope.sum()) + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def _marked(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """docs with whether their id is among the n ids confirmed_id: by broadcast if these are few, else by a shuffled join."""
    return docs.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, F.col("doc_id") == F.col("confirmed_id"), "left").withColumn("confirmed", F.col("confirmed_id").isNotNull())


def train(docs: DataFrame, labels: DataFrame, held_out: str = "held_out", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets of the features, their weights, bias) from rows of docs that are not held out."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold(F.col("doc_id"), 5) != 0)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = own.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("p")).first()
    prior = seen.p / seen.n if seen.n else 0.0
    if not seen.p:
        return np.zeros(0, dtype=np.int64), np.zeros(0), -35.0
    ids = own.filter(F.col("toxic") == 1).select(F.col("doc_id").alias("confirmed_id"))
    taught = docs.filter(~F.col(held_out)).select("doc_id", "text")
    stats = _marked(taught, ids, seen.p).select("text", "confirmed").mapInArrow(_count, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter("bucket < 0 OR p > 0 OR u >= 100").toPandas()
    whole = stats[stats["bucket"] < 0]
    n_p, n_u = int(whole["p"].sum()), int(whole["u"].sum())
    stats = stats[stats["bucket"] >= 0].sort_values("bucket")
    if not n_p or not len(stats):
        return np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    seen_p, expected = stats["p"].to_numpy().astype(float), stats["u"].to_numpy() * (n_p / n_u)
    ratio = 2 * (seen_p * np.log(np.maximum(seen_p, 1e-9) / expected) - (seen_p - expected))
    best = np.argsort(-ratio, kind="stable")[:MAX_FEATURES]
    chosen = np.sort(stats["bucket"].to_numpy()[best[ratio[best] >= MIN_RATIO]])
    shared = docs.sparkSession.sparkContext.broadcast(chosen)
    share = int((1 << 30) * min(1.0, max_unlabelled / max(1, n_u)))
    hashed = F.pmod(F.xxhash64(F.lit("toxic"), "confirmed_id"), F.lit(1 << 30))
    fitted = ids.filter(hashed < int((1 << 30) * min(1.0, max_positive / seen.p)))
    sample = _marked(taught, fitted, min(seen.p, max_positive)).withColumn("marginal", F.pmod(F.xxhash64(F.lit("unlabelled"), "doc_id"), F.lit(1 << 30)) < share).filter(F.col("confirmed") | F.col("marginal"))
    got = sample.select("text", "confirmed", F.coalesce("marginal", F.lit(False)).alias("marginal")).mapInArrow(_present(shared, ["confirmed", "marginal"]), "confirmed boolean, marginal boolean, feats array<int>").toPandas()
    lists = got["feats"].to_list()
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    feat = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]) if len(row) else np.zeros(0, dtype=np.int64)
    weights, bias = nnpu(row, feat, got["confirmed"].to_numpy().astype(bool), got["marginal"].to_numpy().astype(bool), len(chosen), prior)
    return chosen, weights, bias


def score(docs: DataFrame, keep: list[str], model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """The columns `keep` of every document with its score."""
    sc = docs.sparkSession.sparkContext
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    run = _present(sc.broadcast(model[0]), keep, sc.broadcast(model[1:]))
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(F.col("doc_id"), 5) == 0).alias("held_out"))
    return score(rows, ["doc_id", "held_out"], train(rows, labels)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
