"""Line dedup: an exact set-similarity self-join over the lines of all documents, in DataFrame operations only.

A line's set is its distinct words (runs of anything but ASCII white space, unchanged). A line is removed if an earlier
line (smaller doc_id, or the same document and further up) has Jaccard similarity of at least `percent` / 100
with it; lines are judged on the input, so what matches a removed line goes too.

1.  Rarity: words are counted over all documents in 2 ** BITS hash buckets, a table of fixed size. A word's code
    opens with its bucket's rank and ends in its hash, so all lines order their words alike, rare ones first.
2.  Lines with equal sets collapse into the first of them by a 64-bit hash of the codes and the rarest code; the others are removed.
3.  The prefix filter: lines can only match if they share one of their n - ceil(percent * n / 100) + 1 rarest
    words. Where the first word they share is a frequent one (HOT), all they share are, and they share a second within one
    word more; so a frequent word's list is split by the second word. A semi-join on these keys, with the length filter, the
    positional filter and a parity filter (64 bits, 128 for long lines, each flipped by the words that hash to it: two lines differ in at least
    as many words as in bits), keeps the lines that may match any other; as a semi-join it makes no pairs.
4.  These lines are verified word by word. A key's list first meets its earliest line, then what nothing has matched
    yet meets 16, 256, ... of the list's lines at random, as far as they are earlier, until it has met all. So groups of near
    copies are settled by a few lines each and never make all their pairs, and nothing is cut.

Defined cases: null text stays null (0 lines); lines without a word are kept and match nothing; rows that share a
doc_id (or have none) are documents of their own in order of text, equal ones counting as one (each result row is
the same); an emptied document stays, with empty text; very long texts are split whole, a line at a time; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, near, packed, scratch, small, text_changed, unpacked, written

PERCENT = 80
BITS = 19
#: Occurrences of a bucket's words, as a power of two, from which a word is frequent.
HOT = 16
#: Words of a line from which its parity has 128 bits.
LONG = 64
#: Lines of a list that are met grow by this factor a round.
GROW = 16
_AT = ["rid", "pos"]


def _plain(text: str) -> Column:
    """The text with every ASCII white space but the line feed as a blank."""
    odd = F.lit(False)
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(F.col(text))


def _ranks(docs: DataFrame, bits: int) -> DataFrame:
    """One row with one array: the rarity rank of each bucket of words, a logarithm of its count, in the top 12 bits."""
    spark = docs.sparkSession
    words = docs.select(F.explode(F.split(F.replace(_plain("text"), F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter("w <> ''")
    counts = written(words.groupBy(F.shiftrightunsigned(F.xxhash64("w"), 64 - bits).alias("bucket")).agg(F.count("*").alias("n")), "counts")
    rank = F.floor(16 * F.log2(F.coalesce("n", F.lit(0)) + F.lit(1))).cast("int")
    every = spark.range(1 << bits, numPartitions=1).join(F.broadcast(counts), F.col("id") == F.col("bucket"), "left")
    return every.select(F.sort_array(F.collect_list(F.struct("id", rank.alias("rank")))).alias("x")).select(F.transform("x.rank", lambda r: F.shiftleft(r.cast("long"), 52)).alias("ranks"))


def _sets(docs: DataFrame, percent: int, bits: int) -> DataFrame:
    """Each line with a word: lid, rid, pos, size n, a hash of its set and its rarest code, parity, and the codes of its prefix."""
    lines = docs.select("rid", F.posexplode(F.split(_plain("text"), "\n")).alias("pos", "line")).filter(F.trim("line") != "").withColumn("ranks", _ranks(docs, bits).scalar())

    def code(h: Column) -> Column:
        # never null, so that the codes are sorted as plain longs
        return F.coalesce(F.get("ranks", F.shiftrightunsigned(h, 64 - bits)), F.lit(0).cast("long")).bitwiseOR(F.shiftrightunsigned(h, 12))

    hashes = F.array_distinct(F.transform(F.array_remove(F.split("line", " "), ""), lambda w: F.xxhash64(w)))
    codes = lines.select(*_AT, F.sort_array(F.transform(hashes, code)).alias("codes"))
    n = F.size("codes")

    def parity(bit: Callable[[Column], Column]) -> Column:
        return F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", bit(c), c.bitwiseAND(F.lit(63)).cast("int"))))

    # long lines: also the parity of those words whose next bit is set
    more = F.when(n > LONG, parity(lambda c: F.shiftrightunsigned(c, 6).bitwiseAND(F.lit(1).cast("long")))).otherwise(F.lit(0).cast("long"))
    return codes.select(F.monotonically_increasing_id().alias("lid"), *_AT, n.alias("n"), F.xxhash64("codes").alias("one"), F.get("codes", F.lit(0)).alias("two"), parity(lambda c: F.lit(1).cast("long")).alias("parity"), more.alias("more"), F.slice("codes", 1, n - F.ceil(n * percent / 100).cast("int") + 2).alias("prefix"))


_ROW = [*_AT, "n", "parity", "more"]


def _lists(lines: DataFrame, percent: int, row: list[str] = _ROW) -> DataFrame:
    """A row for each key (code) of each line, with its columns `row`: a prefix word at place i, or a frequent one there with one after it."""
    # the first shared word stands among all of a prefix but its last word
    firsts = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1

    def frequent(code: Column) -> Column:
        return F.shiftrightunsigned(code, 52) >= 16 * HOT

    def keys(i: Column) -> Column:
        word = F.get("prefix", i)
        return F.when(frequent(word), F.transform(F.slice("prefix", i + 2, F.size("prefix")), lambda other: F.xxhash64(word, other))).otherwise(F.array(word))

    # words are in order of rarity, so the last one says whether any is frequent
    any_frequent, places = frequent(F.get("prefix", firsts - 1)), F.sequence(F.lit(0), firsts - 1)
    at = F.when(any_frequent, F.flatten(F.transform(places, lambda i: F.array_repeat(i, F.size(keys(i))))))
    every = F.when(any_frequent, F.flatten(F.transform(places, keys))).otherwise(F.slice("prefix", 1, firsts))
    return lines.select(*row, at.alias("at"), F.posexplode(every).alias("i", "code")).select(*row, F.coalesce(F.get("at", "i"), "i").alias("i"), "code")


def _may_match(percent: int, x_n: Column, y_n: Column, x_i: Column, y_i: Column) -> Column:
    """Length, parity and positional filters on a pair of prefix rows (aliases x and y), given their sizes and places."""
    p, both = percent, x_n + y_n
    whole, half = (F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")) for c in ("parity", "more"))
    differ = F.when(F.least(x_n, y_n) > LONG, F.bit_count(whole.bitwiseXOR(half)) + F.bit_count(half)).otherwise(F.bit_count(whole))
    # words before the shared one may be shared too: a pair meets at each word that its prefixes share
    before, after = F.least(x_i, y_i), F.least(x_n - x_i, y_n - y_i)
    return (100 * F.least(x_n, y_n) >= p * F.greatest(x_n, y_n)) & ((100 + p) * differ <= (100 - p) * both) & ((100 + p) * (before + after) >= p * both)


def _earlier() -> Column:
    return (F.col("y.rid") < F.col("x.rid")) | ((F.col("y.rid") == F.col("x.rid")) & (F.col("y.pos") < F.col("x.pos")))


_PAIR = ["x_rid", "x_pos", "y_rid", "y_pos"]


def _places() -> list[Column]:
    return [F.col(c) for c in ("x.n", "y.n", "x.i", "y.i")]


def _pairs(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """Pairs of prefix rows with an earlier y that pass the filters."""
    return _ids(x.alias("x").join(y.alias("y"), (F.col("x.code") == F.col("y.code")) & _earlier() & _may_match(percent, *_places())))


def _ids(met: DataFrame) -> DataFrame:
    """(x_rid, x_pos, y_rid, y_pos) of the pairs x and y."""
    return met.select(*(F.col(c.replace("_", ".")).alias(c) for c in _PAIR))


def _candidates(able: DataFrame, percent: int) -> DataFrame:
    """(lid) of the lines that share a prefix word with another line and pass the filters with it."""
    # narrow rows, as each line is shuffled once for each of its keys: size and place share a column
    lists = _lists(able, percent, ["lid", "n", "parity", "more"]).select("lid", "parity", "more", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i")).alias("span"), "code")
    n = [F.shiftright(f"{side}.span", 32) for side in "xy"]
    i = [F.col(f"{side}.span").bitwiseAND(F.lit((1 << 32) - 1)) for side in "xy"]
    other = F.col("x.lid") != F.col("y.lid")
    return lists.alias("x").join(lists.alias("y"), (F.col("x.code") == F.col("y.code")) & other & _may_match(percent, *n, *i), "left_semi").select("lid").distinct()


def _words_of(docs: DataFrame, at: DataFrame) -> DataFrame:
    """(rid, pos, words) of the lines at (rid, pos)."""
    by_doc = written(at.groupBy("rid").agg(F.collect_list("pos").alias("at")), "at")
    cut = docs.join(near(by_doc), "rid").select("rid", F.split(_plain("text"), "\n").alias("lines"), "at")
    each = cut.select("rid", F.explode(F.arrays_zip("at", F.transform("at", lambda p: F.get("lines", p)).alias("line"))).alias("x"))
    return each.select("rid", F.col("x.at").alias("pos"), F.array_distinct(F.array_remove(F.split("x.line", " "), "")).alias("words"))


def _verified(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """(rid, pos) of each x that a y of its pairs (a written table) matches."""
    few = small(pairs)

    def side(name: str) -> DataFrame:
        return words.select(F.col("rid").alias(f"{name}_rid"), F.col("pos").alias(f"{name}_pos"), F.col("words").alias(f"{name}_words"))

    x, y = side("x"), side("y")
    if few:
        # few pairs go to the words, so that only the words they need are shuffled, once
        x = x.join(F.broadcast(pairs.select("x_rid", "x_pos")), ["x_rid", "x_pos"], "left_semi")
    both = y.join(F.broadcast(pairs) if few else pairs, ["y_rid", "y_pos"]).join(x, ["x_rid", "x_pos"])
    shared = F.size(F.array_intersect("x_words", "y_words"))
    return both.filter((100 + percent) * shared >= percent * (F.size("x_words") + F.size("y_words"))).select(F.col("x_rid").alias("rid"), F.col("x_pos").alias("pos")).distinct()


def later_matches(docs: DataFrame, percent: int = PERCENT, bits: int = BITS) -> DataFrame:
    """(rid, pos) of the lines of docs (rid, text) that match an earlier line."""
    sets = written(_sets(docs, percent, bits), "lines")
    first = written(sets.groupBy("one", "two").agg(F.min(F.struct(*_AT)).alias("first"), F.count("*").alias("n")).filter("n > 1").select("one", "two", "first"), "first")
    copies = written(sets.select(*_AT, "one", "two").join(near(first), ["one", "two"]).filter((F.col("rid") != F.col("first.rid")) | (F.col("pos") != F.col("first.pos"))).select(*_AT), "copies")
    # a set so small that one word more is too many matches only its equals
    able = sets.filter(100 * F.col("n") >= percent * (F.col("n") + 1)).join(near(copies), _AT, "left_anti")
    at = written(_candidates(able, percent), "near")
    members = written(able.join(near(at), "lid", "left_semi").select(*_ROW, "prefix"), "members")
    words = written(_words_of(docs, members.select(*_AT)), "words")
    spot = F.pmod(F.xxhash64(*_AT), F.lit(1 << 40))
    lists = written(_lists(members, percent).withColumn("spot", spot), "keys")
    # a list's earliest line and its number of lines; a list of one line makes no pairs
    heads = written(lists.groupBy("code").agg(F.min(F.struct(*_ROW, "i")).alias("y"), F.count("*").alias("k")).filter("k > 1"), "heads")
    lists = written(lists.join(heads, "code"), "lists")
    found, open_lines, turn = copies, members.select(*_AT), 0
    while True:
        if turn == 0:
            # of its lists' earliest lines, a line meets the earliest
            met = lists.select(F.struct(*_ROW, "i").alias("x"), "y").filter(_earlier() & _may_match(percent, *_places()))
            pairs = _ids(met).groupBy("x_rid", "x_pos").agg(F.min(F.struct("y_rid", "y_pos")).alias("y")).select("x_rid", "x_pos", "y.*")
        else:
            # lists that have met all of their lines are done
            rest = lists.drop("y").filter(F.col("k") > (GROW ** (turn - 1) if turn > 1 else 1))
            x = rest.join(near(open_lines), _AT, "left_semi")
            if not x.limit(1).count():
                return found
            upto = [F.least(F.lit(1.0), F.lit(float(GROW**t)) / F.col("k")) * F.lit(float(1 << 40)) for t in (turn - 1, turn)]
            y = rest.filter((F.col("spot") < upto[1]) & (F.col("spot") >= upto[0] if turn > 1 else F.lit(True)))
            pairs = _pairs(x, y, percent).distinct()
        got = written(_verified(written(pairs, "pairs"), words, percent), "matched")
        found = found.unionByName(got)
        open_lines = written(open_lines.join(near(got), _AT, "left_anti"), "open")
        turn += 1


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with `text` freed of later matches, and the columns n_lines (before) and n_removed at the end.

    Other columns stay as they are; n_chars, where there is one, follows the text.
    """
    rows, back = keyed(docs)
    with scratch() as result:
        gone = result(later_matches(rows, percent).groupBy("rid").agg(F.sort_array(F.collect_set("pos")).alias("_gone")), "gone")
    if back is None:
        joined = packed(docs, "doc_id", "text").join(near(gone.withColumnRenamed("rid", "_rid")), F.col("doc_id") == F.col("_rid"), "left")
    else:
        of = rows.join(back, "rid").join(gone, "rid").select(F.col("id").alias("_id"), F.col("text").alias("_text"), "_gone")
        joined = packed(docs, "doc_id", "text").join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text") == F.col("_text")), "left")
    joined = joined.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split("text", "\n")))
    ends = F.concat("_gone", F.array(F.size("_lines")))

    def kept(end: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get("_gone", i - 1) + 1)
        return F.slice("_lines", begin + 1, end - begin)

    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(F.transform(ends, kept)), "\n"))
    counts = {"n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long"), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    done = joined.withColumn("_kept", text)
    return unpacked(done, docs.columns, text_changed(F.col("_kept"), docs.columns), counts)


def digest(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 (of the text that stays)."""
    out = deduplicate(docs.select("doc_id", "text"), percent)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), s AS (
  SELECT doc_id, pos, line, list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l
), t AS (SELECT *, list_sort(w) AS k FROM s WHERE len(w) > 0),
f AS (SELECT k, min((doc_id, pos)) AS place FROM t GROUP BY k),
g AS (SELECT row_number() OVER (ORDER BY place) AS id, k, len(k) AS n FROM f),
x AS (SELECT id, n, unnest(k) AS w FROM g),
p AS (
  SELECT a.id FROM x a JOIN x b ON a.w = b.w AND a.id > b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)
), m AS (SELECT k FROM g WHERE id IN (SELECT id FROM p)),
r AS (
  SELECT t.doc_id, t.pos FROM t JOIN f ON t.k = f.k LEFT JOIN m ON t.k = m.k WHERE m.k IS NOT NULL OR (t.doc_id, t.pos) <> f.place
), c AS (
  SELECT l.doc_id, count(*) AS n_lines, count(r.pos) AS n_removed, string_agg(CASE WHEN r.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS kept
  FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.pos = r.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id
"""
