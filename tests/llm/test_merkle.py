"""The manifest against trees built whole."""

import hashlib
import random
import zlib

import pytest

from segmentry.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, grp string, digest int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    i, _, lang, source, n = row[:5]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(nodes):
    """All levels of a tree, its leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def walk(levels, i, node):
    """Siblings from leaf i to the root, and the root that `node` in its place gives."""
    siblings = []
    for level in levels[:-1]:
        run = level[i - i % 3 : i - i % 3 + 3]
        siblings += run[: i % 3] + run[i % 3 + 1 :]
        node = sha("".join(node if k == i % 3 else x for k, x in enumerate(run)))
        i //= 3
    return siblings, node


def brute(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1]))) for s in sources}
    trees = {s: tree([leaf_of(r, r[1]) for r in g]) for s, g in groups.items()}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(groups[s]):
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            below, node = walk(trees[s], i, leaf_of(r, text))
            above, root = walk(top, k, node)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], sha("".join(below + above)), root, root == top[-1][0]))
    return sorted(out, key=repr) if rows else []


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def collected(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=repr)


def corpus(n=260, seed=4):
    rng = random.Random(seed)
    names = [None, "", "a", "a", "a", "é", "zz", "𝄞", "﹏", "b"]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "x", "a\nb", "\n\n", "one\ntwo ü\n", "plain"]) if i else "w\n" * 50_000
        rows.append((rng.randrange(-50, 4 * n), text, rng.choice(["en", None]), rng.choice(names), rng.choice([None, 5, -1])))
    rows += [(None, "no\nid", None, "a", None), (None, None, None, None, None), *[(7, "again\n", "en", "a", 3)] * 40, (8, "alone", "en", "only", 1)]
    return rows


@pytest.mark.parametrize("height", [1, 2, 8])
def test_matches_whole_trees(spark, height):
    rows = corpus()
    got = collected(merkle.digest(table(spark, rows), height, 1 if height == 2 else 2))
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_small_tables(spark):
    for rows in ([], [(1, "a\nb", None, None, None)], [(5, None, None, "s", 1), (6, "\n", None, "s", 1)]):
        assert collected(merkle.digest(table(spark, rows))) == brute(rows)


def test_paths_of_all_sizes():
    for n in [*range(1, 30), 80, 81, 82, 243, 244]:
        leaves = [sha(str(i)).encode() for i in range(n)]
        levels = tree([x.decode() for x in leaves])
        height = merkle.levels_of(n)
        assert merkle.block_root(leaves, height).decode() == levels[-1][0]
        for subtree in (1, 2, 3):
            for i, path in enumerate(merkle.paths(leaves.__getitem__, n, height, subtree)):
                siblings, root = walk(levels, i, leaves[i].decode())
                assert merkle.siblings_of(path).decode() == "".join(siblings)
                assert merkle.folded(leaves[i], path).decode() == root == levels[-1][0]
                assert merkle.from_text(merkle.to_text(path)) == path


def test_traversal_holds_two_subtrees_a_layer(monkeypatch):
    n, height, subtree, live = 3**6, 6, 2, []
    made = merkle.Subtree.__init__

    def noted(self, *a):
        made(self, *a)
        live.append(self)

    monkeypatch.setattr(merkle.Subtree, "__init__", noted)
    most, asked = 0, []
    leaves = [sha(str(i)).encode() for i in range(n)]
    for _ in merkle.paths(lambda i: asked.append(i) or leaves[i], n, height, subtree):
        live[:] = live[-6:]  # three layers of two at most
        most = max(most, sum(len(k) for t in live for k in t.kept) + sum(len(r) for t in live for r in t.runs))
    assert most < 120  # of 1,092 nodes below the root
    assert len(asked) <= 3 * n + 100  # each layer reads a leaf once


def test_a_short_block_has_all_its_levels(spark):
    rows = [(i, "t", None, "s", 1) for i in range(10)]  # a block of nine and one of one
    got = collected(merkle.digest(table(spark, rows), 2, 1))
    assert got == brute(rows)


def test_duckdb_gives_the_same_rows(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.sql(merkle.SQL).fetchall(), key=repr)
    assert collected(merkle.digest(spark.read.parquet(f"{folder}/documents.parquet"))) == want
