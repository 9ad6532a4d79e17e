"""Language predictions and the toxicity risk, worked out plainly."""

import random
import zlib

import numpy as np
import pytest

from segmentry.llm import language, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    """The trigrams of a text: lower-cased letters, one blank for any run of others and at either end."""
    t = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    t = " " + " ".join(t.split()) + " "
    return [t[i : i + 3] for i in range(len(t) - 2)] if t.strip() else []


def vector(found):
    letter = lambda c: language._letter(0 if c == " " else ord(c)).astype(float)
    return sum((np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in found), np.zeros(language.DIM))


def test_language_predictions_are_the_nearest_prototypes(spark):
    rng = random.Random(7)
    stock = {"en": "the and of with that from there which would about".split(), "de": "der die und mit nicht eine werden über straße auch".split(), "fr": "le la et des avec pour qui une été où".split()}
    rows = []
    for i in range(90):
        lang = rng.choice(list(stock))
        text = rng.choice([" ", ", ", "\n1 "]).join(rng.choice(stock[lang]) for _ in range(rng.randrange(1, 40)))
        rows.append((i, rng.choice([text, text.upper()]), None if i % 11 == 0 else lang, "s", 0))
    rows += [(90, None, "en", "s", 0), (91, "123 !", "en", "s", 0), (92, "", None, "s", 0), (None, "der und die", "de", "s", 0), (93, "𝔘nd 日本 語", "de", "s", 0)]
    sums = {}
    for i, text, lang, _, _ in rows:
        held = i is not None and zlib.crc32(str(i).encode()) % 3 == 1
        found = grams(text)
        if not held and lang is not None and found:
            sums[lang] = sums.get(lang, 0) + vector(found) / len(found)
    names = sorted(sums)
    whole = np.array([sums[x] / np.linalg.norm(sums[x]) for x in names])
    centred = whole - whole.mean(axis=0)
    centred /= np.linalg.norm(centred, axis=1, keepdims=True)
    got = {r.doc_id: r for r in language.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, _, _, _ in rows:
        found, r = grams(text), got[i]
        if not found:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = vector(found)
        cosine = centred @ v / np.linalg.norm(v)
        assert r.score == pytest.approx(min(1.0, max(0.0, cosine.max())), abs=1e-4)
        if np.sort(cosine)[-1] - np.sort(cosine)[-2] > 1e-4:
            assert r.lang_pred == names[int(cosine.argmax())]
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)


def test_toxic_features_by_hand():
    texts = ["Bad words, bad WORDS", "", "unbelievable things"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    row, bucket = toxicity.features(data, offsets)
    # words once a row: bad, words; unbelievable and its two prefixes, things (six letters: no longer than the first prefix)
    assert [int((row == r).sum()) for r in range(3)] == [2, 0, 4]
    again, same = toxicity.features(np.frombuffer(b"words bad", dtype=np.uint8), np.array([0, 9]))
    assert set(same.tolist()) == set(bucket[row == 0].tolist()) and set(again.tolist()) == {0}


def risks(theta, x, confirmed, marginal, prior):
    """prior R_p(+), and R_u(-) - prior R_p(-), with the logistic loss, document by document."""
    z = [sum(theta[j] for j in f) + theta[-1] for f in x]
    loss = lambda v: float(np.log1p(np.exp(-v)))
    p, u = [v for v, c in zip(z, confirmed, strict=True) if c], [v for v, c in zip(z, marginal, strict=True) if c]
    return prior * sum(map(loss, p)) / len(p), sum(loss(-v) for v in u) / len(u) - prior * sum(loss(-v) for v in p) / len(p)


@pytest.mark.parametrize("overlap", [False, True])
def test_the_first_step_goes_down_the_non_negative_risk(overlap):
    rng = random.Random(5)
    n, k = 40, 6
    x = [sorted(rng.sample(range(k), rng.randrange(1, k))) for _ in range(n)]
    confirmed = np.array([i < 15 for i in range(n)])
    # with few unlabelled rows of little loss the second part can fall below zero
    marginal = np.array([i < 15 and overlap or i >= 15 for i in range(n)])
    row, feat = np.repeat(np.arange(n), [len(f) for f in x]), np.array([j for f in x for j in f])
    signs = set()
    for prior in (0.05, 0.3, 0.95):
        theta = np.append(np.zeros(k), np.log(prior / (1 - prior)))
        _, second = risks(theta, x, confirmed, marginal, prior)
        signs.add(second >= 0)

        def objective(t, prior=prior, second=second):
            a, b = risks(t, x, confirmed, marginal, prior)
            return a + b if second >= 0 else -b

        slope = np.array([(objective(theta + 1e-6 * e) - objective(theta - 1e-6 * e)) / 2e-6 for e in np.eye(k + 1)])
        w, bias = toxicity.nnpu(row, feat, confirmed, marginal, k, prior, steps=1, rate=0.01, decay=0.0)
        moved = np.append(w, bias) - theta
        clear = np.abs(slope) > 1e-5
        assert clear.any() and (np.sign(moved[clear]) == -np.sign(slope[clear])).all()
    assert True in signs


def test_long_training_lowers_the_risk():
    rng = random.Random(9)
    n, k, prior = 200, 5, 0.25
    x = [[0, 1 + i % 4] if i < 50 or i % 4 == 0 else [1 + i % 4] for i in range(n)]
    confirmed, marginal = np.array([i < 50 for i in range(n)]), np.array([i >= 50 for i in range(n)])
    row, feat = np.repeat(np.arange(n), [len(f) for f in x]), np.array([j for f in x for j in f])
    w, bias = toxicity.nnpu(row, feat, confirmed, marginal, k, prior)
    total = lambda t: (lambda a, b: a + max(0.0, b))(*risks(t, x, confirmed, marginal, prior))
    found = total(np.append(w, bias))
    assert found < total(np.append(np.zeros(k), np.log(prior / (1 - prior)))) and w[0] == max(w)
    assert all(found <= total(np.append(w, bias) + np.array([rng.uniform(-3, 3) for _ in range(k + 1)])) + 0.02 for _ in range(50))
