"""A Merkle manifest of the documents: a proof for each of them, by fractal tree traversal.

Leaves are hashed by Spark. A source's leaves, in order, are cut into aligned blocks of 3**HEIGHT; a block is one piece of
work. Its authentication paths come out leaf after leaf from stacked subtrees of SUBTREE levels: of each layer there is an
existing subtree, which holds the siblings that the present path needs, and a desired one, the next to the right, into which
every step hashes one more leaf, so that it is whole when the path leaves the existing one. What is held besides the block's
leaf digests are two subtrees a layer.

Block roots are the leaves of the next tier, cut into blocks again, until each source has one root; the subroots are
the leaves of one more tree. Paths then go down tier by tier: the path of a block (its upper proof) is one row that joins
the block's leaves, and each leaf's proof ends with it. No task holds more than a block, no source is in one task, and
nothing but counts of partitions passes through the driver.

Defined cases: nulls hash as `-`; a null doc_id comes before all others and isn't tampered with; leaves of equal doc_id are
in the order of their digests, so repeated rows are leaves of their own; a null source is the first source; very long texts
are hashed whole by Spark; an empty table gives an empty manifest; other columns aren't hashed and don't matter.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import near, written

RADIX = 3
#: Levels of a block (6,561 leaves), and of a subtree in it.
HEIGHT = 8
SUBTREE = 2
#: Rows of a result that a task gathers before it passes them on.
ROWS = 4096
#: Per level of a path from below: the node's place in its run, and its siblings' digests.
Path = list[tuple[int, list[bytes]]]


def digest_of(joined: bytes) -> bytes:
    return hashlib.sha256(joined).hexdigest().encode()


class Subtree:
    """The nodes of levels low to top - 1 of a tree over leaves that are added one by one; lower nodes only while their run is open."""

    def __init__(self, low: int, top: int):
        self.low, self.top = low, top
        self.runs: list[list[bytes]] = [[] for _ in range(top)]
        self.kept: list[list[bytes]] = [[] for _ in range(top)]

    def _put(self, node: bytes, level: int) -> None:
        self.runs[level].append(node)
        if level >= self.low:
            self.kept[level].append(node)

    def _raise(self, level: int) -> None:
        node, self.runs[level] = digest_of(b"".join(self.runs[level])), []
        self._put(node, level + 1)

    def add(self, leaf: bytes) -> None:
        self._put(leaf, 0)
        level = 0
        while level < self.top - 1 and len(self.runs[level]) == RADIX:
            self._raise(level)
            level += 1

    def close(self) -> None:
        """After the last leaf: runs that are short end too."""
        for level in range(self.top - 1):
            if self.runs[level]:
                self._raise(level)

    def root(self) -> bytes:
        return digest_of(b"".join(self.runs[self.top - 1]))


def levels_of(leaves: int) -> int:
    """Levels from the leaves of a tree to its root."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // RADIX), height + 1
    return height


def block_root(leaves: Sequence[bytes], height: int) -> bytes:
    if not height:
        return leaves[0]
    tree = Subtree(height - 1, height)
    for leaf in leaves:
        tree.add(leaf)
    tree.close()
    return tree.root()


def paths(leaf: Callable[[int], bytes], n: int, height: int, subtree: int = SUBTREE) -> Iterator[Path]:
    """The authentication path of each of a block's n leaves in turn; leaf(i) gives a leaf's digest."""
    if not height:
        yield from ([] for _ in range(n))
        return
    bounds = [(low, min(height, low + subtree)) for low in range(0, height, subtree)]
    existing = [Subtree(*b) for b in bounds]
    for tree in existing:
        for i in range(min(n, RADIX**tree.top)):
            tree.add(leaf(i))
        tree.close()
    desired = [Subtree(*b) for b in bounds[:-1]]
    for i in range(n):
        path = []
        for tree in existing:
            for level in range(tree.low, tree.top):
                at = i // RADIX**level % RADIX ** (tree.top - level)  # in this subtree's row
                run = tree.kept[level][at - at % RADIX : at - at % RADIX + RADIX]
                path.append((at % RADIX, run[: at % RADIX] + run[at % RADIX + 1 :]))
        yield path
        for k, tree in enumerate(desired):
            width = RADIX**tree.top
            ahead = i + width  # the leaf of the next subtree that stands where this one stands in its own
            if ahead < n:
                tree.add(leaf(ahead))
            if (i + 1) % width == 0:
                tree.close()
                existing[k], desired[k] = tree, Subtree(*bounds[k])


def folded(node: bytes, path: Path) -> bytes:
    """The root that a node and its path give."""
    for place, siblings in path:
        node = digest_of(b"".join([*siblings[:place], node, *siblings[place:]]))
    return node


def to_text(path: Path) -> str:
    return "".join(f"{place}{len(siblings)}" + b"".join(siblings).decode() for place, siblings in path)


def from_text(text: str) -> Path:
    out, at, data = [], 0, text.encode()
    while at < len(data):
        n = int(data[at + 1 : at + 2])
        out.append((int(data[at : at + 1]), [data[at + 2 + 64 * k : at + 66 + 64 * k] for k in range(n)]))
        at += 2 + 64 * n
    return out


def siblings_of(path: Path) -> bytes:
    return b"".join(s for _, siblings in path for s in siblings)


def hashed(*values: Column) -> Column:
    """H of the values: each `-` if null, else its length in bytes, a colon and itself; as 32 bytes."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, digest, shown): each document's group (its source), leaf, and the leaf as tampered with where that differs."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return docs.select(
        _group(F.col("source")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), hashed(*fields, F.col("text")).alias("digest"),
        F.when(tampered, hashed(*fields, F.translate("text", "\n", ""))).alias("shown"), F.monotonically_increasing_id().alias("_tie"))


def _group(source: Column) -> Column:
    """A source as a text that is never null and keeps the order: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with grp) with `pos`, their place in their group by `order`, and `total`, the group's rows. The last of `order` tells all rows apart."""
    ranked = written(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    ranked = ranked.withColumn("_part", F.shiftright("_at", 33))
    # a row for each group in each partition: what a group has in partitions before
    parts = ranked.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(parts.select("grp", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("total")), "starts")
    return ranked.join(near(starts), ["grp", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift", *(c for c in order if c.startswith("_")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The columns of each block in turn, of rows sorted by grp, block and pos."""
    held: dict[str, list] = {}
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        keys = list(zip(columns["grp"], columns["block"], strict=True))
        at = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[at]:
                continue
            if held and (held["grp"][0], held["block"][0]) != keys[at]:
                yield held
                held = {}
            for c, v in columns.items():
                held.setdefault(c, []).extend(v[at:i])
            at = i
    if held:
        yield held


def _gathered(found: Iterator[dict[str, list]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: dict[str, list] = {}
    for columns in found:
        for c, v in columns.items():
            out.setdefault(c, []).extend(v)
        if len(out[schema.names[0]]) >= ROWS:
            yield pa.RecordBatch.from_pydict(out, schema=schema)
            out = {}
    if out:
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def _hex(digest: bytes) -> bytes:
    return digest.hex().encode()


def _height(total: int, height: int) -> int:
    """Levels of a block in a group of that many leaves: those of its tree, or of a whole block where it has several."""
    return levels_of(total) if total <= RADIX**height else height


def _roots(height: int):
    kinds = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("digest", pa.binary()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict[str, list]]:
            for b in _blocks(batches):
                total = b["total"][0]
                root = block_root([_hex(d) for d in b["digest"]], _height(total, height))
                yield {"grp": b["grp"][:1], "pos": b["block"][:1], "digest": [bytes.fromhex(root.decode())], "total": [-(-total // RADIX**height)]}

        yield from _gathered(each(), kinds)

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _blocked(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / RADIX**height))


def roots(nodes: DataFrame, height: int) -> DataFrame:
    """(grp, pos, digest, total) of the roots of the blocks of nodes (grp, pos, digest, total)."""
    rows = _dealt(_blocked(nodes.select("grp", "pos", "digest", "total"), height))
    return written(rows.mapInArrow(_roots(height), "grp string, pos long, digest binary, total long"), "roots")


def _walk(b: dict[str, list], height: int, subtree: int) -> tuple[str, list[bytes], Iterator[Path]]:
    """The upper proof in a block's first row, the digests of the others, and their paths in the block."""
    nodes = [_hex(d) for d in b["digest"][1:]]
    return b["path"][0], nodes, paths(nodes.__getitem__, len(nodes), _height(b["total"][1], height), subtree)


def _node_paths(height: int, subtree: int):
    kinds = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("path", pa.string()), ("top", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict[str, list]]:
            for b in _blocks(batches):
                upper, nodes, found = _walk(b, height, subtree)
                yield {"grp": b["grp"][1:], "block": b["pos"][1:], "path": [to_text(p) + upper for p in found], "top": b["top"][:1] * len(nodes)}

        yield from _gathered(each(), kinds)

    return run


def _with_upper(nodes: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """nodes dealt by block, each block behind its row of `upper` (grp, block, path, ...)."""
    return _dealt(_blocked(nodes, height).unionByName(upper.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True))


def upper_proofs(nodes: DataFrame, height: int = HEIGHT, subtree: int = SUBTREE) -> DataFrame:
    """(grp, block, path, top): the path of each block of nodes to the root of its group, and that root."""
    found = roots(nodes, height)
    single = found.filter("total = 1").select("grp", F.col("pos").alias("block"), F.lit("").alias("path"), F.col("digest").alias("top"))
    several = found.filter("total > 1")
    if not several.limit(1).count():
        return single
    rows = _with_upper(several, upper_proofs(several, height, subtree), height)
    shape = "grp string, block long, path string, top binary"
    return written(single.unionByName(rows.select("grp", "block", "pos", "digest", "total", "path", "top").mapInArrow(_node_paths(height, subtree), shape)), "upper")


_ROW = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def _proofs(height: int, subtree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict[str, list]]:
            for b in _blocks(batches):
                text, nodes, found = _walk(b, height, subtree)
                upper, subroot, root = from_text(text), b["top"][0].hex(), b["root"][0].hex()
                end, above = siblings_of(upper), {}
                proofs, tops = [], []
                for leaf, shown, path in zip(nodes, b["shown"][1:], found, strict=True):
                    proofs.append(hashlib.sha256(siblings_of(path) + end).hexdigest())
                    here = folded(_hex(shown) if shown is not None else leaf, path)
                    if here not in above:  # leaves that weren't tampered with meet in the block's root
                        above[here] = folded(here, upper).decode()
                    tops.append(above[here])
                n = len(nodes)
                yield {"doc_id": b["doc_id"][1:], "leaf": [x.decode() for x in nodes], "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": tops, "verified": [t == root for t in tops]}

        yield from _gathered(each(), _ROW)

    return run


def digest(docs: DataFrame, height: int = HEIGHT, subtree: int = SUBTREE) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    nodes = written(placed(written(leaves(docs), "leaves"), ["doc_id", "digest", "_tie"]), "nodes")
    upper = written(upper_proofs(nodes, height, subtree), "block-proofs")
    # the subroots are the leaves of one more tree
    subroots = placed(upper.filter("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("_source"), F.col("top").alias("digest")).withColumn("source", F.col("_source")), ["_source"])
    subroots = written(subroots, "subroots")
    above = upper_proofs(subroots, height, subtree)
    shape = "grp string, block long, path string, top binary"
    lasts = _with_upper(subroots.select("grp", "pos", "digest", "total"), above, height).select("grp", "block", "pos", "digest", "total", "path", "top")
    proofs = written(lasts.mapInArrow(_node_paths(height, subtree), shape).withColumnRenamed("block", "pos"), "subroot-proofs")
    sources = written(subroots.select("source", "pos").join(near(proofs.select("pos", F.col("path").alias("_last"), F.col("top").alias("root"))), "pos"), "sources")
    joined = upper.join(near(sources.select(F.col("source").alias("grp"), "_last", "root")), "grp")
    heads = joined.select("grp", "block", F.concat("path", "_last").alias("path"), "top", "root")
    rows = _with_upper(nodes, heads, height).select("grp", "block", "pos", "doc_id", "digest", "shown", "total", "path", "top", "root")
    return rows.mapInArrow(_proofs(height, subtree), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: The bits of a decimal number's characters, lowest first, shifted through the CRC one by one.
_BITS = "flatten([[(ascii(c) >> i) & 1 for i in range(0, 8)] for c in string_split(CAST(doc_id AS VARCHAR), '')])"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], {_BITS}), lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"

#: DuckDB SQL for the rows of `digest`, over tables of unique doc_ids.
SQL = string.Template("""
WITH RECURSIVE d AS (SELECT doc_id, source, $leaf AS leaf, CASE WHEN $crc % 2 = 0 THEN $tampered ELSE $leaf END AS shown FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM d),
u AS (SELECT source, 0 AS level, pos, leaf AS x FROM l
  UNION ALL SELECT source, level + 1, pos // 3, sha256(string_agg(x, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM u) WHERE n > 1 GROUP BY source, level, pos // 3),
s AS (SELECT source, max(level) AS height, max_by(x, level) AS subroot FROM u GROUP BY source),
t AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM s),
v AS (SELECT 0 AS level, place AS pos, subroot AS x FROM t
  UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(x, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM v) WHERE n > 1 GROUP BY level, pos // 3),
r AS (SELECT max(level) AS height, max_by(x, level) AS root FROM v),
b AS (SELECT l.doc_id, u.level, u.pos, u.x FROM l JOIN u ON u.source IS NOT DISTINCT FROM l.source AND u.pos // 3 = l.pos // CAST(3 ** (u.level + 1) AS BIGINT) AND u.pos <> l.pos // CAST(3 ** u.level AS BIGINT)
  UNION ALL SELECT l.doc_id, 1000 + v.level, v.pos, v.x FROM l JOIN t ON t.source IS NOT DISTINCT FROM l.source JOIN v ON v.pos // 3 = t.place // CAST(3 ** (v.level + 1) AS BIGINT) AND v.pos <> t.place // CAST(3 ** v.level AS BIGINT)),
p AS (SELECT doc_id, sha256(string_agg(x, '' ORDER BY level, pos)) AS proof FROM b GROUP BY doc_id),
f AS (SELECT doc_id, source, 0 AS level, pos, shown AS y FROM l
  UNION ALL SELECT f.doc_id, f.source, f.level + 1, f.pos // 3, sha256(string_agg(CASE WHEN u.pos = f.pos THEN f.y ELSE u.x END, '' ORDER BY u.pos))
  FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source JOIN u ON u.source IS NOT DISTINCT FROM f.source AND u.level = f.level AND u.pos // 3 = f.pos // 3 WHERE f.level < s.height GROUP BY f.doc_id, f.source, f.level, f.pos),
g AS (SELECT f.doc_id, 0 AS level, t.place AS pos, f.y FROM f JOIN t ON t.source IS NOT DISTINCT FROM f.source AND t.height = f.level
  UNION ALL SELECT g.doc_id, g.level + 1, g.pos // 3, sha256(string_agg(CASE WHEN v.pos = g.pos THEN g.y ELSE v.x END, '' ORDER BY v.pos))
  FROM g JOIN r ON g.level < r.height JOIN v ON v.level = g.level AND v.pos // 3 = g.pos // 3 GROUP BY g.doc_id, g.level, g.pos)
SELECT l.doc_id, l.leaf, t.subroot, r.root, coalesce(p.proof, sha256('')) AS proof_sha256, g.y AS folded_root, g.y = r.root AS verified
FROM l JOIN t ON t.source IS NOT DISTINCT FROM l.source CROSS JOIN r JOIN g ON g.doc_id = l.doc_id AND g.level = r.height LEFT JOIN p ON p.doc_id = l.doc_id
""").substitute(leaf=_leaf("text"), tampered=_leaf("replace(text, chr(10), '')"), crc=_CRC)
