"""Each operator against brute force on small tables with nulls, empties, copies, ties and clashing columns."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentry.llm import components, decontaminate, html_text, jaccard, language, lattice, lines, mixing, quality, substrings, toxicity
from segmentry.llm.automaton import SuffixAutomaton

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; they must pass as other columns.
CLASH = {"rid": 1, "n": 2, "spans": 3, "items": 4, "place": 5, "code": 6, "words": 7, "_gone": 8, "count": 9}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus(seed=1, n=60):
    """doc_id, text rows with shared passages, near copies, exact copies, repeated lines, empties and a null."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "naïve", "日本", "x.", "A-b"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 19, 20, 21, 50, 120]))]
        if i % 5 == 0:
            at = rng.randrange(len(words) + 1)
            cut = rng.randrange(0, 30)
            words[at:at] = passage[cut : cut + rng.randrange(10, 31)]
        if i % 4 == 1:
            words = base[:]
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = ""
        for j, w in enumerate(words):
            text += w + ("\n" if rng.random() < 0.08 else rng.choice([" ", " ", " ", "  ", "\t"]) if j % 7 == 0 else " ")
        if i % 9 == 2 and out:
            text = out[rng.randrange(len(out))] or ""
        out.append(text)
    return [(3 * i + 1, None if i == 7 else t) for i, t in enumerate(out)]


def table(spark, rows, extra=True):
    full = [(i, t, ("en", "fr", None)[k % 3], ("a", "b", None, "c")[k % 4], len(t or "")) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}) if extra else df


def test_op1_matches_brute_force(spark):
    rows = corpus()
    seen, want = {}, {}
    for i, t in sorted(rows):
        words = WORD.findall(t or "")
        gone = set()
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                gone.update(range(s, s + 20))
            else:
                seen[window] = (i, s)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        want[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(table(spark, rows)).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 100


def test_op1_large_anchor_groups_take_the_other_way(spark):
    rows = corpus(2, 40)
    docs = table(spark, rows).select(F.col("doc_id").alias("rid"), "text")
    cover = lambda df: {(r.rid, w) for r in df.collect() for w in range(r.start, r.start + r.windows)}
    assert cover(substrings.repeated_spans(docs)) == cover(substrings.repeated_spans(docs, max_runs=1))


def test_op1_reference_shards(spark):
    rng = random.Random(4)
    ref = [" ".join(rng.choice("abcdefgh") for _ in range(80)) for _ in range(3)]
    text = "start " + " ".join(ref[1].split()[10:45]) + " end"
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in substrings.remove_reference(docs, spark.createDataFrame([(t,) for t in ref], "text string"), 20, 90).collect()}
    assert got == {1: "start end", 2: "nothing here", 3: ""}


def test_suffix_automaton_matching_statistics():
    rng = random.Random(9)
    stock = [[rng.randrange(3) for _ in range(12)] for _ in range(4)]
    a = SuffixAutomaton()
    for s in stock:
        a.add(s)
    asked = [rng.randrange(4) for _ in range(40)]
    inside = lambda x: any(x == s[i : i + len(x)] for s in stock for i in range(len(s)))
    assert a.matching(asked) == [max(k for k in range(e + 2) if not k or inside(asked[e + 1 - k : e + 1])) for e in range(len(asked))]


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body><header>Head</header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>First   par&eacute;graph, with text.<p>Second&nbsp;one &#8211; more <b>bold</b> text, and more of it.
<script>var t="</p>";</script><aside>Aside</aside><div class="ad">Buy</div></article><section id="comments"><p>I think, so there.</section><form><input><label>Mail</label></form><footer>Foot</footer></body></html>"""


def test_op2_article_without_the_rest(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "plain  text &lt;3"), (4, "w", "plain  text &lt;3")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.digest(pages).collect()))
    body = "A & B\n\nFirst parégraph, with text.\n\nSecond one – more bold text, and more of it."
    assert got == [(1, body, len(body)), (2, "", 0), (3, "", 0), (4, "plain text <3", 13), (4, "plain text <3", 13)]


@pytest.mark.parametrize("opens", ["<body>", "", "<div>", "<body class=x><div>"])
def test_op2_ends_a_head_that_no_tag_closes(opens):
    page = f"<!doctype html><html><head><meta charset=utf-8><title>No</title><style>p{{}}</style>\n<script>1</script>{opens}<article><p>First line, with text.<p>Second line, more of it.</article>"
    assert html_text.main_text(page) == "First line, with text.\n\nSecond line, more of it."
    assert html_text.main_text("<head><title>No</title>\n plain text") == "plain text"


LONG = "It is a long line of text, dense and with marks; it says much, and then some more of it, until it ends."


def test_op2_keeps_what_a_class_or_id_only_names():
    head = f"<html><body><div class=ad>Buy</div><article><h1>Title</h1><p>{LONG}<p>{LONG}"
    tail = f"<div class=share><a href=x>Share</a></div><div class=advert>{LONG}</div></article><section id=comments><p>{LONG}</section></body></html>"
    base = ["Title", LONG, LONG]
    for part, more in [
        (f"<section id=discussion><h2>Discussion</h2><p>{LONG}</section>", ["Discussion", LONG]),
        (f"<section class=related-work><h2 id=related-work>Related work</h2><p>{LONG}<p>{LONG}</section>", ["Related work", LONG, LONG]),
        (f"<h2 id=search-algorithms>Search algorithms</h2><p>{LONG}", ["Search algorithms", LONG]),
        (f"<h2 id=legal-notice>Legal notice</h2><p class=side-effects>{LONG}", ["Legal notice", LONG]),
        (f"<div id=skip-navigation><p>{LONG}</div>", [LONG]),
        ("", []),
    ]:
        assert html_text.main_text(head + part + tail).split("\n\n") == base + more
        if part:  # <main> alone does as well
            assert html_text.main_text((head + part).replace("article", "main")).split("\n\n") == base + more


def test_op2_keeps_content_paths_outside_the_container():
    ad, foot = "<div class=ad>Buy</div>", "<div class=low><a href=x>Home</a> <a href=y>About us</a></div>"
    lead = f"{ad}<div class=intro><h1>Title</h1><p>{LONG}<p>{LONG}</div>"
    story = f"<div class=story><p>{LONG}<h2>Part</h2><p>{LONG}<p>{LONG}<ul><li>One<li>Two</ul></div>"
    text = ["Title", LONG, LONG, LONG, "Part", LONG, LONG, "One", "Two"]
    assert html_text.main_text(f"<body>{lead}{story}{foot}").split("\n\n") == text
    assert html_text.main_text(f"<body>{lead}<h3>By A</h3>{story.replace('story', 'x')}{foot}").split("\n\n") == text[:3] + ["By A"] + text[3:]
    two = [f"<article class={c}><h1>{c}</h1>{f'<p>{LONG}' * n}</article>" for c, n in (("a", 2), ("b", 3))]
    assert html_text.main_text(f"<body>{ad}{''.join(two)}{foot}").split("\n\n") == ["a", LONG, LONG, "b", LONG, LONG, LONG]
    assert html_text.main_text(f"<body>{lead}{two[1]}<div class=low>Made by us</div>").split("\n\n") == ["Title", LONG, LONG, "b", LONG, LONG, LONG]


def test_op2_survives_broken_markup():
    rng = random.Random(2)
    for _ in range(300):
        html_text.main_text("".join(rng.choice(["<p>", "</p>", "<div class='x'>", "</div>", "<", ">", "text ", "&amp", "<!--", "<script>", "<a href='", "</", "<td>"]) for _ in range(30)))


def brute_content(found):
    """Content paths by the docstring's words: means per path, Gaussian over neighbours of a section, fused, damped, thresholded."""
    of = {}
    for b in found:
        of.setdefault(b.path, []).append(b)
    mean = lambda p, f: sum(map(f, of[p])) / len(of[p])
    score = {}
    for i, b in enumerate(found):
        near = [(math.exp(-0.5 * (i - j) ** 2), found[j]) for j in range(max(0, i - 2), min(len(found), i + 3)) if html_text._home(found[j].path) == html_text._home(b.path)]
        text, marks = (sum(w * mean(x.path, f) for w, x in near) / sum(w for w, _ in near) for f in (lambda x: len(x.text), lambda x: x.marks))
        value = text * (1 + marks)
        if b.factor < 1:
            value = b.factor * min(value, mean(b.path, lambda x: len(x.text)) * (1 + mean(b.path, lambda x: x.marks)))
        value *= 1 - sum(x.links for x in of[b.path]) / sum(len(x.text) for x in of[b.path])
        score[b.path] = max(score.get(b.path, 0), value)
    level = html_text.SHARE * math.sqrt(sum((v - sum(score.values()) / len(score)) ** 2 for v in score.values()) / len(score)) if len(score) > 1 else 0
    return score, {p for p, v in score.items() if v >= level and v > 0}


def test_op2_ratios_match_brute_force_and_decide():
    rng = random.Random(4)
    changed = 0
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            body = " ".join(rng.choice(["word,", "text", "more.", "<a href=x>link</a>"]) for _ in range(rng.choice([1, 3, 40])))
            parts.append(rng.choice(["<p>{}</p>", "<div class=a><p>{}</p></div>", "<div class=related>{}</div>", "<h2>{}</h2>", "<article><p>{}</p></article>", "<ul><li>{}</li></ul>", "<section id=b>{}</section>"]).format(body))
        found = html_text.blocks("<body>" + "".join(parts))
        ratio = html_text._ratios(found)
        score, content = brute_content(found)
        assert ratio == pytest.approx(score) and html_text.content_paths(found, ratio) == content
        changed += html_text.content_paths(found, {p: rng.random() for p in ratio}) != content
    assert changed > 75


@pytest.mark.parametrize("page", [
    "<body><form><div class=nav><a href=x>Home</a></div><div>{}</div></form>", "<body><div class='content has-sidebar'>{}</div><div class=sidebar>Side text.</div>",
    "<body><div class='post no-comments'>{}</div><footer>Made by us.</footer>", "<body><div class='legal news'>{}</div>",
])
def test_op2_keeps_the_article_of_a_damped_wrapper(page):
    assert html_text.main_text(page.format(f"<h1>Title</h1><p>{LONG}<p>{LONG}")) == f"Title\n\n{LONG}\n\n{LONG}"


def test_op2_titles_and_pages_without_an_article():
    assert html_text.main_text(f"<article><div class=article-header><h1>Title</h1></div><p>{LONG}<p>{LONG}</article>") == f"Title\n\n{LONG}\n\n{LONG}"
    assert html_text.main_text("<body><nav><a href=x>Home</a></nav><footer>Some words of a footer.</footer>") == ""


@pytest.mark.parametrize("part", ["<a ", "<! ", '<a b="', "</p>", "<p>a", "<a x='>", "<div>x", "<li>", "<!--", "<script>"])
def test_op2_reads_broken_pages_in_proportion(part):
    began = time.time()
    html_text.main_text(part * 100_000)
    assert time.time() - began < 20


def test_op2_empty_table_and_long_page(spark):
    schema = "page_id long, url string, html string"
    assert html_text.digest(spark.createDataFrame([], schema)).count() == 0
    (r,) = html_text.digest(spark.createDataFrame([(1, None, f"<article>{f'<p>{LONG}' * 20_000}</article>")], schema)).collect()
    assert r.n_chars == len(r.text) == 20_000 * (len(LONG) + 2) - 2


def test_op3_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(3000):
        toxic = i % 8 == 0
        rows.append((i, " ".join(rng.choice(["vile", "nasty", "grim"]) if toxic and rng.random() < 0.2 else f"w{rng.randrange(200)}" for _ in range(40)), None, None, 0))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(None, None, None, None, 0), (10**6, "", None, None, 0)]
    got = toxicity.digest(spark.createDataFrame(rows, SCHEMA).withColumn("toxic", F.lit(1)).withColumn("score", F.lit(2)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum((r.predicted == 1) == (r.doc_id % 8 == 0) for r in held) > 0.98 * len(held)


def test_op3_without_positives(spark):
    got = toxicity.digest(table(spark, corpus(3, 10)), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 10 and all(r.predicted == 0 for r in got)


def test_op3_statistics_count_every_positive_whatever_the_fit_takes(spark, monkeypatch):
    rng = random.Random(8)
    rare = [f"slur{k}" for k in range(6)]
    # each rare word stands in 20 of 120 toxic documents: enough by all of them, too few by a tenth
    rows = [(i, " ".join([f"w{rng.randrange(50)}" for _ in range(15)] + ([rare[i // 25 % 6]] if i % 25 == 0 else [])), False) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    labels = spark.createDataFrame([(i, 1, int(i % 25 == 0)) for i in range(0, 3000, 5)], "doc_id long, quality int, toxic int")
    chosen = toxicity.train(docs, labels)[0]
    assert len(chosen) >= len(rare)
    few, _, bias = toxicity.train(docs, labels, max_positive=10)
    assert few.tolist() == chosen.tolist()
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)  # by shuffled joins
    again, _, again_bias = toxicity.train(docs, labels, max_positive=10)
    assert again.tolist() == chosen.tolist() and abs(bias - again_bias) < 1e-6


def brute_lines(rows, percent=80):
    seen, out = [], {}
    for i, t in sorted(rows):
        kept, n, gone = [], 0, 0
        for line in (t.split("\n") if t is not None else []):
            n += 1
            s = frozenset(WORD.findall(line))
            hit = bool(s) and any(100 * len(s & o) >= percent * len(s | o) for o in seen)
            if s:
                seen.append(s)
            gone += hit
            if not hit:
                kept.append(line)
        out[i] = (n, gone, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot, grow, long", [(16, 16, 32), (0, 2, 2), (3, 3, 1000)])
def test_op4_matches_brute_force(spark, monkeypatch, hot, grow, long):
    monkeypatch.setattr(lines, "HOT", hot)
    monkeypatch.setattr(lines, "GROW", grow)
    monkeypatch.setattr(lines, "LONG", long)
    rng = random.Random(8)
    base = [f"v{rng.randrange(40)}" for _ in range(14)]
    rows = corpus(5, 30)
    for i in range(60):  # a group of near copies, of lines from five words to fourteen
        words = base[: rng.randrange(5, 15)]
        words[rng.randrange(len(words))] = f"v{rng.randrange(40)}"
        rows.append((1000 + i, " ".join(words) + "\n\n" + "  ".join(reversed(words)) + "\n"))
    docs = table(spark, rows)
    want = brute_lines(rows)
    found = lines.later_matches(docs.select(F.col("doc_id").alias("rid"), "text"))
    assert found.count() == found.distinct().count() == sum(w[1] for w in want.values())
    if hot == 16:
        got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in lines.digest(docs).collect()}
        assert got == want


@pytest.mark.parametrize("few", [True, False])
def test_op4_counts_lists_once_and_drops_lone_keys(spark, monkeypatch, few):
    kept, write = {}, lines.written
    monkeypatch.setattr(lines, "small", lambda df: few)
    monkeypatch.setattr(lines, "GROW", 2)
    monkeypatch.setattr(lines, "written", lambda df, name: kept.setdefault(name, []).append(write(df, name)) or kept[name][-1])
    base = [f"b{i}" for i in range(20)]
    rows = [(i, " ".join(base[:18] + [f"own{i}", f"odd{i}"])) for i in range(12)] + [(100 + i, f"alone{i} " * 9) for i in range(5)]
    found = lines.later_matches(table(spark, rows).select(F.col("doc_id").alias("rid"), "text"))
    assert {r.rid for r in found.collect()} == {i for i, (_, gone, _) in brute_lines(rows).items() if gone} == set(range(1, 12))
    (lists,) = kept["lists"]
    sizes = {r.code: (r["count"], r.k) for r in lists.groupBy("code", "k").count().collect()}
    assert sizes and all(n == k > 1 for n, k in sizes.values()) and "sizes" not in kept


def test_op4_keeps_columns(spark):
    docs = table(spark, [(1, "one two three four five\nsix"), (2, "one two three four five\nnew line here"), (3, None), (4, "")])
    got = {r.doc_id: r for r in lines.deduplicate(docs).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == ["one two three four five\nsix", "new line here", None, ""]
    assert [got[i].n_chars for i in (1, 2, 3)] == [27, 13, None] and got[2].code == 6 and got[2].rid == 1


def test_op5_matches_brute_force(spark):
    rows = corpus(11, 40)
    source = [t for _, t in rows if t and len(ALNUM.findall(lower(t))) > 20]
    bench = [(1, " ".join(ALNUM.findall(lower(source[0]))[3:18])), (2, "W5"), (3, "nowhere to be found at all in any of these texts"), (4, None), (5, ""), (10, source[1].upper())]
    words = {i: ALNUM.findall(lower(t or "")) for i, t in rows}
    windows = []
    for item, t in bench:
        w = ALNUM.findall(lower(t or ""))
        windows += [(str(item), tuple(w))] if 0 < len(w) < 10 else [(str(item), tuple(w[k : k + 10])) for k in range(len(w) - 9)]
    want = {}
    for i, w in words.items():
        hit, items = set(), set()
        for item, x in windows:
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit.update(range(s, s + len(x)))
                    items.add(item)
        want[i] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digest(table(spark, rows), b).collect()}
    assert got == want and any(w[4] for w in want.values())
    blocks = decontaminate.benchmark_hits(table(spark, rows).select("doc_id", "text"), b, ["doc_id"], block_bytes=100).collect()
    assert {r.doc_id: (sum(r.spans[1::2]) - sum(r.spans[::2]), len(r["items"])) for r in blocks} == {i: (w[1], w[2]) for i, w in want.items()}
    clean = decontaminate.decontaminate(table(spark, rows), b, "documents")
    assert {r.doc_id for r in clean.collect()} == {i for i, w in want.items() if not w[4]}


def test_op6_counts_match_brute_force(spark):
    rows = [*corpus(12, 30), (500, "a b c d e " * 6), (501, "# *x* | <b>\n# *x* | <b>\n\n \ny" + " é" * 12), (502, None)]
    want = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + d for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for d in range(5)}
        real = [x for x in (t or "").split("\n") if WORD.search(x)]
        want[i] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(real) - len(set(real)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w))
    got = quality.digest(table(spark, rows, False)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want
    assert not any(r.kept for r in got if r.base_failed)


def test_op6_rejects_what_is_odd_for_its_group(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["plain", "words", "of", "text", "here", f"n{i}", f"m{rng.randrange(99)}"]) for _ in range(60)), "en", "a", 0) for i in range(400)]
    rows.append((900, " ".join(f"#$%{k} <|> q{k}" for k in range(40)), "en", "a", 0))
    kept = {r.doc_id: r.kept for r in quality.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not kept[900] and sum(kept.values()) > 0.95 * 400


def test_op7_languages(spark):
    rng = random.Random(3)
    words = {"en": "the and of with that from there which would about".split(), "de": "und der die nicht eine werden über schön auch zwischen".split()}
    rows = [(i, " ".join(rng.choice(words[("en", "de")[i % 2]]) for _ in range(30)), ("en", "de")[i % 2], None, 0) for i in range(200)]
    rows += [(1000, None, "en", None, 0), (1001, "123 ... 456", "en", None, 0), (1002, "", None, None, 0), (None, "the and of with", None, None, 0), (1003, "the which would about", None, None, 0)]
    got = {r.doc_id: r for r in language.digest(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(9))).collect()}
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == got[None].lang_pred == "en"
    assert all(got[i].lang_pred == ("en", "de")[i % 2] for i in range(200)) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(200))


def brute_components(rows, k=4, percent=85):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("seed, k, percent, grow, block", [(1, 4, 85, 16, 1000), (2, 4, 85, 2, 3), (3, 5, 80, 16, 1000)])
def test_op8_matches_brute_force(spark, monkeypatch, seed, k, percent, grow, block):
    monkeypatch.setattr(jaccard, "GROW", grow)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(seed)
    rows = corpus(seed, 40)
    base = [f"u{rng.randrange(500)}" for _ in range(90)]
    for i in range(50):  # chains of edits, each near the last
        if rng.random() < 0.7:
            base[rng.randrange(90)] = f"u{rng.randrange(500)}"
        rows.append((2000 + i, " ".join(base) if i % 3 else " ".join(base).upper()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.digest(table(spark, rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)
    kept = {r.doc_id for r in jaccard.deduplicate(table(spark, rows), k, percent).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_op8_t_occurrence_search_gives_exact_overlaps():
    rng = np.random.default_rng(3)
    for percent in (85, 50, 20):
        for _ in range(200):
            query = np.sort(rng.choice(60, rng.integers(1, 30), replace=False)).astype(np.uint64)
            sets = [np.sort(rng.choice(60, rng.integers(1, 30), replace=False)).astype(np.uint64) for _ in range(8)]
            sets += [np.sort(np.append(query[rng.random(len(query)) < 0.9], np.uint64(100))) for _ in range(8)]
            shared = [len(np.intersect1d(query, x)) for x in sets]
            want = [n if 100 * n >= percent * (len(query) + len(x) - n) else 0 for n, x in zip(shared, sets, strict=True)]
            assert jaccard.t_occurrence(query, sets, percent).tolist() == want


def test_op8_closes_a_list_of_many_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROW", 2)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(40):  # each near the base, few near one another; two of them by the same edits
        words = base[:]
        for j in random.Random(i // 2).sample(range(120), 6):
            words[j] = f"e{j}.{i // 2}"
        if i % 2:
            words[rng.randrange(120)] = f"x{i}"
        rows.append((i + 1, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) > 10


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for a, b in edges for x in (a, b) if a != b}


def test_op9_base_score_and_lattice(spark):
    rows = corpus(13, 40)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10 != 0]
    counts = Counter(w for t in train for w in [*WORD.findall(lower(t or "")), "\n"])
    total, types = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lattice.digest(table(spark, rows)).collect()}
    for head in (1, 50):
        for r in lattice.digest(table(spark, rows), head_tokens=head).collect():
            assert (r.n_known, round(r.base_score, 6), round(r.score, 6)) == (got[r.doc_id].n_known, round(got[r.doc_id].base_score, 6), round(got[r.doc_id].score, 6))
    for i, t in rows:
        tokens = [*WORD.findall(lower(t or "")), "\n"]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in tokens)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9, abs_tol=1e-6) and got[i].score < 0
    logs = {"▁": math.log(0.1), "a": math.log(0.2), "b": math.log(0.1), "▁a": math.log(0.2), "ab": math.log(0.15), "▁ab": math.log(0.05)}
    logs |= {f"<0x{x:02X}>": math.log(0.001) for x in range(256)}

    def total_p(s):
        if not s:
            return 1.0
        own = sum(math.exp(logs[s[:k]]) * total_p(s[k:]) for k in range(1, len(s) + 1) if s[:k] in logs)
        return own + (total_p(s[1:]) * math.exp(sum(logs[f"<0x{x:02X}>"] for x in s[0].encode())) if s[0] not in logs else 0.0)

    texts = ["ab", "a", "aabb", "é", "abéab"]
    found = lattice.Lattice(logs).log_probs("".join(texts).encode(), [len(t.encode()) for t in texts])
    assert all(math.isclose(f, math.log(total_p("▁" + t)), rel_tol=1e-9) for f, t in zip(found, texts, strict=True))


def test_op10_targets_and_quotas(spark):
    rng = random.Random(7)
    rows = [(i, None if i == 3 else " ".join(["w"] * rng.choice([0, 1, 5, 60])), "en", rng.choice(["a", "a", "a", "b", "ü", None]), 0) for i in range(500)] + [(900, " ".join(["x"] * 4000), "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"g": F.lit(1), "block": F.lit(2), "size": F.lit(3), "edge": F.lit(4), "copies": F.lit(5)})
    got = mixing.digest(docs).collect()
    again = {r.doc_id: (r.size, r.taken, r.target) for r in mixing.digest(docs.repartition(7)).collect()}
    assert {r.doc_id: (r.size, r.taken, r.target) for r in got} == again and len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes, targets = Counter(), {}
    taken = Counter()
    for r in got:
        assert r.size == len((dict((x[0], x[1]) for x in rows)[r.doc_id] or "").split()) and r.taken <= 3 * r.size
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        targets[source[r.doc_id]] = r.target
    order = sorted((s for s in sizes if s is not None)) + [None]
    assert [targets[s] for s in order] == pytest.approx(mixing.targets([sizes[s] for s in order]))
    assert sum(targets.values()) == pytest.approx(sum(sizes.values())) and all(abs(taken[s] - targets[s]) <= 1 for s in order)
    mixed = mixing.mix(docs, 8).collect()
    assert sum(r.mix_words for r in mixed) == sum(taken.values()) and {r.mix_shard for r in mixed} <= set(range(8))


def test_op10_every_node_of_the_tree_draws_for_itself():
    draws = {tuple(mixing.generator(17, node).integers(0, 1 << 60, 4).tolist()) for node in range(1, 128)}
    assert len(draws) == 127
    quotas = np.array([1024, 300, 0, 2048])
    got = [mixing.split(quotas, 8, seed) for seed in range(300)]
    assert all((g.sum(axis=0) == quotas).all() and (g >= 0).all() for g in got)
    mean, spread = np.mean(got, axis=0), np.std([g[:, 1] for g in got], axis=0)
    assert np.abs(mean - quotas / 8).max() < 3  # the same mixture expected in each shard
    n, k, m = quotas.sum(), quotas[1], quotas.sum() / 8
    assert np.abs(spread / math.sqrt(m * k / n * (1 - k / n) * (n - m) / (n - 1)) - 1).max() < 0.2  # hypergeometric
    assert mixing.block_bits(10) == 10 and mixing.block_bits(5_000_000_000) == 12


def test_op5_op7_memory_is_bounded():
    rng = random.Random(1)
    items = [(str(i), " ".join(f"w{rng.randrange(50000)}" for _ in range(1000))) for i in range(400)]
    tracemalloc.start()
    index = decontaminate.Index(items, 10)
    assert len(index.windows[10][0]) == 400 * 991 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.reset_peak()
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(12000)]
    vectors, _ = language._bundle(texts)
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
    # brute force: a text's vector is the sum over its trigrams of bound, rotated letters
    for i in (0, 7):
        t = f" {texts[i]} "
        letter = lambda c: language._letter(0 if c == " " else ord(c)).astype(int)
        want = sum(np.roll(letter(t[j]), 2) * np.roll(letter(t[j + 1]), 1) * letter(t[j + 2]) for j in range(len(t) - 2))
        assert (vectors[i] == want).all()


def test_op10_shares_by_hand():
    assert mixing.targets([100, 100, 100, 100]) == pytest.approx([300 * 5 / 13 * 4 / 3, 300 * 2 / 13 * 4 / 3, 300 / 13 * 4 / 3, 300 * 5 / 13 * 4 / 3])
    assert mixing.targets([10, 1000]) == pytest.approx([30, 980]) and mixing.targets([0, 0]) == [0.0, 0.0]


OPERATORS = {
    "op1": substrings.digest, "op4": lines.digest, "op6": quality.digest, "op7": language.digest, "op8": jaccard.digest, "op9": lattice.digest, "op10": mixing.digest,
    "op5": lambda d: decontaminate.digest(d, d.sparkSession.createDataFrame([], "item_id long, text string")),
    "op3": lambda d: toxicity.digest(d, d.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_repeated_or_missing_ids(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, text + " more"), (None, text), (None, None), (2, None), (2, ""), (5, "x" * 300_000 + " " + text)]
    got = OPERATORS[name](table(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
