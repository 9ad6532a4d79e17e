"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path of open tags (with their class or id) from the root. For every
distinct path the blocks' text length, punctuation and link text are added up. A path's ratios are its text and its
punctuation per block; they are smoothed over the sequence of blocks (a Gaussian over neighbours in the same section), fused
(text x (1 + punctuation)) and damped by the share of link text. Paths whose fused ratio reaches SHARE of its spread over the
page's paths are content paths, and every block of a content path is kept, wherever it stands.

What elements are called only damps the ratios below them, by a factor for each: much for nav, header, footer, aside and the
like and for roles and classes that name such things, by half for words that in an article (or a main) may as well name what
the text is about. All paths inside a damped wrapper are damped alike, so a page in a <form> or a "has-sidebar" keeps its
article. Damped paths are not lifted by their neighbours.

Paths inside nav, footer, aside or the like are never content and have no part in the spread, so a footer of any length moves
nothing; a page of nothing else has no article. Blocks below the threshold, if undamped, stay with the content around them:
those between two content blocks that aren't mostly links, and what stands in the same section or the same article as the
content block next to it. Headings right before a content block stay whatever their class; so does the last h1 before the
first one, unless it is in a page's header (an article's own header may hold it).

Text of script, style, noscript, template and head is never text, nor is what is hidden. Character references are decoded,
white space inside a block becomes one blank, blocks are joined by an empty line. Unclosed and misnested tags are repaired as
browsers do for p, li, td and the like; an open head ends at the first tag or text that can't stand in one; tags nested deeper
than DEPTH only end blocks. Reading takes time in proportion to the page, however broken.

Defined cases: null or empty html, or a page without a kept block, gives the empty text; plain text without tags is one
block; a tag that never closes is text; very long pages are read whole; a null page_id or url stays null; repeated rows each
get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?>=\s*+(?:"[^"]*+"|'[^']*+')|[^>=]|=)*+)>|([^<]++|<)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
SILENT = RAW | frozenset("head svg math object audio video canvas select option datalist map".split())
#: What may stand in a head; anything else ends it.
HEAD = RAW | frozenset("html head base basefont bgsound link meta".split())
BOILERPLATE = frozenset("nav header footer aside form button menu dialog fieldset input label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img br label".split())
#: A tag that opens closes these, when one of them is the innermost open block.
CLOSES = {t: frozenset({"p"}) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
CLOSES |= {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"})}
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side|aside|widget|cookies?|consent|gdpr|notice|alert|popup|modal|overlay"
    r"|comments?|commentlist|reply|replies|respond|disqus|discussion|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|tags|toolbar|skip|copyright|disclaimer|legal)(?:$|[\s_-])",
    re.I,
)
#: Of these words, those that also name parts of an article.
VAGUE = re.compile(r"^(?:discussion|related|search|navigation|comments?|notice|legal|alert|tags|side|share|sharing|social|skip|disclaimer|copyright)$", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p section".split())
PARTS = HEADINGS | frozenset("p ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption hgroup address".split())
#: Elements that hold no article; a form may hold the whole page.
ASIDE = BOILERPLATE - {"form"}
#: What is left of a ratio below such an element: one that names what isn't text, or one that may name a part of an article.
NAMED, HINTED = 0.002, 0.5
DEPTH = 128
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
SHARE = 0.5
KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)


class Block:
    __slots__ = ("aside", "factor", "links", "marks", "path", "text")

    def __init__(self, path: tuple, text: str, links: int, factor: float, aside: bool):
        self.path, self.text, self.links, self.factor, self.aside = path, text, links, factor, aside
        self.marks = len(PUNCTUATION.findall(text))


class Open:
    """An open element: its name with and without class, whether it hides, what it leaves of ratios, and whether it or one around it is no place for an article."""

    __slots__ = ("aside", "factor", "full", "hides", "name")

    def __init__(self, name: str, full: str, hides: bool, factor: float, aside: bool):
        self.name, self.full, self.hides, self.factor, self.aside = name, full, hides, factor, aside


_RAW_END: dict[str, re.Pattern] = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, without those in silent or hidden elements."""
    out: list[Block] = []
    stack: list[Open] = []
    hidden = links = 0
    text: list[str] = []
    linked = 0
    raw = ""

    def flush() -> None:
        nonlocal text, linked
        if text:
            body = " ".join(html.unescape("".join(text)).split())
            if body:
                top = stack[-1] if stack else None
                out.append(Block(tuple(x.full for x in stack if x.name not in INLINE), body, min(linked, len(body)), top.factor if top else 1.0, bool(top and top.aside)))
        text, linked = [], 0

    def close(at: int) -> None:
        nonlocal hidden, links
        if any(x.name not in INLINE for x in stack[at:]):
            flush()
        for x in stack[at:]:
            hidden -= x.hides
            links -= x.name == "a"
        del stack[at:]

    at, n = 0, len(page)
    last = page.rfind(">")
    while at < n:
        if raw:
            m = _RAW_END[raw].search(page, at)
            at = m.end() if m else n
            raw = ""
            continue
        m = TOKEN.match(page, at) if at <= last else None
        if m is None:  # no tag ends any more
            if stack and stack[-1].name == "head" and page[at:].strip():
                close(len(stack) - 1)
            if not hidden:
                text.append(page[at:])
            break
        at = m.end()
        if m[4] is not None:
            if stack and stack[-1].name == "head" and m[4].strip():
                close(len(stack) - 1)
            if not hidden:
                text.append(m[4])
                if links:
                    linked += len(m[4].strip())
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    close(i)
                    break
                if name in INLINE and stack[i].name not in INLINE:
                    break
            else:
                if name not in INLINE or name == "br":
                    flush()
            continue
        if name not in HEAD and stack and stack[-1].name == "head":
            close(len(stack) - 1)
        if name in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in CLOSES[name]:
                    close(i)
                    break
                if stack[i].name not in INLINE:
                    break
            if name in ("tr", "td", "th", "li", "dt", "dd"):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name in ("table", "ul", "ol", "dl"):
                        break
                    if stack[i].name in CLOSES[name]:
                        close(i)
                        break
        if name == "br":
            text.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name not in INLINE:
            flush()
        marks, role, unseen = "", "", False
        if m[3]:
            for a in ATTRIBUTE.finditer(m[3]):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id"):
                    marks += f" {value}"
                elif key == "role":
                    role = value.lower()
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                    unseen = unseen or key == "hidden" or name not in INLINE
        hides, factor = name in SILENT or unseen, 1.0
        if name in BOILERPLATE or role in ROLES:
            factor = NAMED
        elif marks and name not in ("html", "body", "main", "article") and HINT.search(marks):
            inside = any(x.name in ("article", "main") for x in stack)
            # of several words, one that isn't vague is enough
            vague = name in PROSE or name in HEADINGS or not any(HINT.search(x) and not VAGUE.search(x) for x in re.split(r"[\s_-]+", marks))
            factor = HINTED if inside and vague else NAMED
        if name in RAW:
            raw = name
            continue
        if m[3].rstrip().endswith("/") and name in ("svg", "path", "use"):
            continue
        if len(stack) < DEPTH:
            top = stack[-1] if stack else None
            stack.append(Open(name, f"{name}.{'.'.join(marks.split())}" if marks else name, hides, factor * (top.factor if top else 1.0), name in ASIDE or bool(top and top.aside)))
            hidden += hides
            links += name == "a"
    flush()
    return out


def _name(path: tuple) -> str:
    return path[-1].split(".")[0] if path else ""


def _home(path: tuple) -> tuple:
    """The path to the innermost element that is more than a paragraph, heading, list or table."""
    n = len(path)
    while n and path[n - 1].split(".")[0] in PARTS:
        n -= 1
    return path[:n]


def _article(path: tuple) -> tuple:
    """The path to the innermost article; empty for none."""
    n = len(path)
    while n and path[n - 1].split(".")[0] != "article":
        n -= 1
    return path[:n]


def _titles(block: Block) -> bool:
    """Whether an h1 may be the article's: it is in no nav, footer, aside or the like, but for the header of an article or main."""
    names = [x.split(".")[0] for x in block.path]
    if not block.aside:
        return True
    at = max((i for i, x in enumerate(names) if x in ("article", "main")), default=-1)
    return at >= 0 and not any(x in ASIDE and not (x == "header" and i > at) for i, x in enumerate(names))


def _ratios(found: list[Block]) -> dict[tuple, float]:
    """Each path's fused ratio: text and punctuation per block, smoothed, damped by links and by what elements are called."""
    total: dict[tuple, list[float]] = {}
    for b in found:
        t = total.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        t[0] += len(b.text)
        t[1] += b.marks
        t[2] += b.links
        t[3] += 1
    length = np.array([total[b.path][0] / total[b.path][3] for b in found])
    marks = np.array([total[b.path][1] / total[b.path][3] for b in found])
    home = np.array([hash(_home(b.path)) for b in found])
    sums, weight = np.zeros((2, len(found))), np.zeros(len(found))
    for step, k in zip(range(-2, 3), KERNEL, strict=True):
        here = slice(max(0, -step), len(found) - max(0, step))
        there = slice(max(0, step), len(found) - max(0, -step))
        same = k * (home[here] == home[there])
        weight[here] += same
        sums[:, here] += same * np.array([length[there], marks[there]])
    fused = sums[0] / weight * (1.0 + sums[1] / weight)
    alone = length * (1.0 + marks)
    factor = np.array([b.factor for b in found])
    fused = factor * np.where(factor < 1.0, np.minimum(fused, alone), fused)
    best: dict[tuple, float] = {}
    for b, f in zip(found, fused.tolist(), strict=True):
        best[b.path] = max(best.get(b.path, 0.0), f * (1.0 - total[b.path][2] / max(1.0, total[b.path][0])))
    return best


def content_paths(found: list[Block], ratio: dict[tuple, float]) -> set[tuple]:
    """The paths whose ratio reaches the threshold. Those in nav, footer, aside or the like are none, however long, and don't count for the spread."""
    own = {b.path: ratio[b.path] for b in found if not b.aside}
    level = SHARE * float(np.std(list(own.values()))) if len(own) > 1 else 0.0
    return {p for p, r in own.items() if r >= level and r > 0}


def main_text(page: str | None) -> str:
    """The article of a page as plain text."""
    found = blocks(page or "")
    if not found:
        return ""
    ratio = _ratios(found)
    content = content_paths(found, ratio)
    at = [i for i, b in enumerate(found) if b.path in content]
    if not at:
        return ""
    least = max(found[i].factor for i in at)  # a wrapper's factor is everyone's
    leads = [False] * (len(found) + 1)  # headings with only headings between them and the next content block
    for i in range(len(found) - 1, -1, -1):
        leads[i] = found[i].path not in content and _name(found[i].path) in HEADINGS and i + 1 < len(found) and (found[i + 1].path in content or leads[i + 1])
    title = max((i for i in range(at[0]) if _name(found[i].path) == "h1" and _titles(found[i])), default=-1)
    if any(_name(found[i].path) == "h1" for i in at):
        title = -1
    kept, n = [], 0  # n: content blocks so far
    for i, b in enumerate(found):
        if b.path in content:
            kept.append(b.text)
            n += 1
            continue
        stays = leads[i] and not b.aside or i == title
        if not stays and b.factor >= least and 2 * b.links <= len(b.text):
            beside = [found[j] for j in at[max(0, n - 1) : n + 1]]  # the content block before and the one after
            stays = 0 < n < len(at) or any(_home(b.path) == _home(x.path) or _article(b.path) and _article(b.path) == _article(x.path) for x in beside)
        if stays:
            kept.append(b.text)
    return "\n\n".join(kept)


def _extract(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return run


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` of each page with text and n_chars."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select(*keep, "html").mapInArrow(_extract(list(keep)), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string, n_chars long"]))


digest = extract
