"""The aligner against whole-text tokens and all pairs of byte ranges."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from segmentry.llm import alignment

SCHEMA = "doc_id long, text string, row string, pair int"


@pytest.fixture(scope="module")
def tokenizers():
    a, b = Tokenizer.from_file(alignment.BYTE_LEVEL), SentencePieceProcessor(model_file=alignment.PIECES)
    a.encode_special_tokens = True
    with open(alignment.BYTE_LEVEL, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters = alignment.byte_letters()
    of_a = {i: bytes(letters[c] for c in e) for e, i in vocabulary.items()}
    of_b = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    return a, b, of_a, of_b


def spans(ids, of):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(of[i]), i))
        at += len(of[i])
    return out


def brute(rows, tokenizers):
    """The contract's columns, from whole texts and every pair of overlapping ranges."""
    a, b, of_a, of_b = tokenizers
    linked, count, found = [], Counter(), []
    for i, text in rows:
        x = spans(a.encode(" " + text, add_special_tokens=False).ids, of_a) if text else []
        y = spans(b.encode(text), of_b) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(of_a[t[2]] for t in x) != whole or b"".join(of_b[t[2]] for t in y) != whole:
            x, y = [], []
        pairs = [(p[2], q[2]) for p in x for q in y if p[0] < q[1] and q[0] < p[1]]
        ends = sorted({p[1] for p in x} & {q[1] for q in y})
        groups, low = [], 0
        for end in ends:
            groups.append(",".join(str(p[2]) for p in x if low <= p[0] < end) + "|" + ",".join(str(q[2]) for q in y if low <= q[0] < end))
            low = end
        linked.append(pairs)
        count.update(set(pairs))
        found.append((i, len(x), len(y), len(groups), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    most = defaultdict(int)
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    return sorted(
        ((i, n_a, n_b, g, n, sum(count[p] == most[p[0]] for p in pairs), sum(count[p] for p in pairs), sha) for (i, n_a, n_b, g, n, sha), pairs in zip(found, linked, strict=True)),
        key=repr,
    )


def texts(seed=2):
    rng = random.Random(seed)
    odd = ["", None, "a", " ", "  two  spaces ", "a▁b", "zero​ width​ x", "᠎ x ᠎ y", "<|endoftext|> </s> <unk> <0x0A> plain", "日本 語 です", "\x00 a\x00 b", "😀 😀😀", "1 2 ½ ² ٣", "\r\n a \r b", "x" * 900, "it's don't 'll x's"]
    letters = " \n\t  abcéß日1²'.,-<>|_▁😀́\x1c ​"
    odd += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(80)]
    words = ["the", "straße", "überall", "tokenizers", "naïve", "x", "ing", "https://a.b/c?d=1", "don't", "1234567", "é"]
    odd += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    odd += odd[-5:]
    return [(None if k == 3 else 5 * k, t) for k, t in enumerate(odd)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], SCHEMA)


def collected(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("near", [alignment.NEAR, 40, 0])
def test_matches_brute_force(spark, tokenizers, near):
    rows = texts()
    rows.append(rows[20])  # a repeated row counts again
    got = collected(alignment.digest(table(spark, rows), near=near))
    assert got == brute(rows, tokenizers)


def test_long_texts_go_by_slices(spark, tokenizers, monkeypatch):
    rows = texts(5)
    known = alignment.Aligner(alignment.BYTE_LEVEL, alignment.PIECES)
    monkeypatch.setattr(alignment, "SLICE", 30)
    monkeypatch.setattr(alignment, "CACHE", 20)
    for (_, text), want in zip(rows, [brute([r], tokenizers)[0] for r in rows], strict=True):
        doc = alignment._Document()
        for part in alignment.slices(text or ""):
            known.learn(set(part))
            doc.add(known, part)
        n_a, n_b, n_groups, n_links, sha, pairs, times = doc.row()
        assert (n_a, n_b, n_groups, n_links, sha, sum(times)) == (*want[1:5], want[7], want[4])
        assert list(pairs) == sorted(set(pairs))


def test_transducer_follows_suffixes():
    bytes_of = ([b"ab", b"c", b"abc", b"d"], [b"a", b"bcd", b"b", b"cd", b"d"])
    t = alignment.Transducer(bytes_of)

    def align(a, b):
        links = []
        return t.align(a, b, links), [(x >> 32, x & 0xFFFFFFFF) for x in links]

    assert align([0, 1, 3], [0, 1]) == (["0,1,3|0,1"], [(0, 0), (0, 1), (1, 1), (3, 1)])
    assert align([2, 3], [0, 2, 3]) == (["2,3|0,2,3"], [(2, 0), (2, 2), (2, 3), (3, 3)])
    before = dict(t.steps)
    align([0, 1, 3], [0, 1])
    assert t.steps == before  # all steps were known
    for a, b in (([0], [4]), ([0], [0]), ([0], [0, 2, 4])):
        with pytest.raises((IndexError, ValueError)):
            align(a, b)


def test_tables_of_nothing(spark):
    assert collected(alignment.digest(table(spark, []))) == []
    assert collected(alignment.digest(table(spark, [(1, None), (None, "")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_whole_documents_table(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("row", F.lit(1))
    assert collected(alignment.digest(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], tokenizers)
