"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. Each is described by its word count and link density, those of
the blocks before and after it, and by how the page marks the place it stands in. A tree fitted on a small
table of labelled blocks keeps or drops it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_IN_TAG = re.compile(r"[>\"']")
_ATTRIBUTES = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Elements whose content is plain characters up to their end tag, and elements of controls, drawings and copies; the text of both is not the page's.
RAW = frozenset("script style textarea title iframe noscript noframes noembed".split())
SILENT = frozenset("template svg select button".split())
#: Elements that end a block where they begin and end.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that may hold others and so are kept on the stack of open elements.
NESTED = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol search section table td th ul".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW | SILENT}
_BOTH = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I) for tag in SILENT}
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.I)
_CHROME = frozenset("nav aside footer menu dialog search".split())
_SOFT_CHROME = frozenset("header form".split())
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header "
    "masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pagination paywall popup promo promos promotion related reply "
    "replies respond responses share sharing sidebar social sponsor sponsored subscribe taboola toolbar widget widgets".split()
)
#: A header that is named after one of these is that of the text itself.
_CONTENT_HINTS = frozenset("article content main post entry story text body".split())
#: What an article element must be named to be no article.
_COMMENT_HINTS = frozenset("comment comments reply replies respond responses".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements inside a block whose text can be furniture by itself.
_INLINE = frozenset("a abbr b cite em font i ins mark small span strong u".split())

#: Labelled blocks, a page a line and in the page's order: + if part of the main text, else -; words; words in links; and how
#: the place is marked: a in an article, f in page furniture, nothing if it is not marked.
LABELLED = (
    "-1/1f -1/1f -2/2f -1/1f -8/0f +7/0a +90/0a +45/0a +12/0a +1/0a +300/2a +3/0a +20/0a -9/0f",
    "-2/2f -1/1f -1/1f -10/0f +6/0a +8/0a +2/0a +1/0a +5/0a +2/0a -6/0f -2/0f",
    "-3/0f -40/0f -60/0f -35/0f +5/0a +120/4a +80/0a +30/9a +20/0a +4/0a -25/2f -80/0f -70/0f -3/3f",
    "-1/1f -12/0f +4/0a +60/0a +5/5a +50/0a +1/1a +40/0a -120/0f -90/0f -15/0f -8/0f",
    "+5/0a +70/1a -2/2a -3/3a -1/1a -4/4a +60/0a +12/0a -2/2a -2/2a -1/1a -3/3a",
    "-1/1a -2/2a -2/2a +6/0a +110/0a +20/0a -4/4a -6/6a -5/5a -3/3a",
    "+8/0a +1/0a +2/0a +2/1a +1/0a +60/30a +25/10a +3/0a -7/7a -9/9a -8/8a +30/0a",
    "-1/1 -2/2 -1/1 -3/3 +3/0 +2/0 +60/1 +45/0 +80/3 +4/0 +70/0 -1/1 -2/2 -1/1",
    "-2/2 -1/1 -8/6 +5/0 +40/0 +25/0 +9/0 +50/5 -10/8 -2/2 -3/3 -4/0 -2/2",
    "-1/1 -1/1 -2/1 -1/1 -3/0 -2/2 +6/0 +30/0 +3/0 +35/0 -2/2 -6/5 -1/1",
    "-2/0 -2/2 -1/1 +4/0 +2/0 +200/10 +1/0 +150/0 +12/1 +90/0 -40/36 -20/19 -2/2",
    "-8/8 -9/9 -7/7 -60/55 -30/28 -5/5",
    "-2/2 -3/0 -2/2 -5/0 -1/1 -8/0 -2/2",
    "+45/0", "+3/0a", "+1/0a +2/0a", "-30/0f", "-3/0f -4/4f", "-2/2",
    "+4/0 +30/0 +20/0", "+60/0 +3/0 +60/0 +8/2 +50/0 +5/5 +40/0",
    "-50/0f -6/0f -45/3f +4/0a -20/0f -60/0f",
    "+80/0 +60/0 -2/2 -1/1 -3/3 -7/0", "-7/0 -2/2 -1/1 +5/0 +70/0 +40/0", "+90/2a +50/0a -2/2 -3/3 -6/0",
    "-1/1f -1/1f +6/0a +1/0a +30/0a -2/2f -1/1f", "-1/1f -2/2f +1/0a", "-2/2f +7/0a +2/0a +9/0a +1/0a -5/5f -1/1f", "-1/1f +3/0a -2/2f -4/4f", "-2/2f +2/0a -3/3f",
    "-1/1f -2/2f +12/0a +1/0a", "-3/3f +25/0a +1/0a +4/0a -1/1f", "+1/0a -2/2f", "-1/1f +1/0a +40/0a +10/0a -6/6f", "-1/1f +40/6a -2/2f", "-2/2 +3/0a +1/0a -2/2", "-1/1 +12/0a -2/2",
    "+4/0a -2/2a +60/0a +40/0a", "+8/0a -3/3a -2/2a +50/0a +30/0a", "+6/0a -1/1a +20/0a +2/0a", "+40/0a -2/2a +35/0a",
)
MARKS = {"a": 1, "f": -1, "": 0}
FEATURES = ("words", "link density", "words before", "density before", "words after", "density after", "mark")


def described(found: list[tuple[int, int, int]]) -> list[tuple]:
    """The features of the blocks (words, words in links, mark) of a page."""
    plain = [(0, 0.0), *((w, linked / w) for w, linked, _ in found), (0, 0.0)]
    return [(*plain[i + 1], *plain[i], *plain[i + 2], mark) for i, (*_, mark) in enumerate(found)]


def labelled() -> tuple[tuple, ...]:
    """The labelled blocks, each with its features and its label."""
    out = []
    for page in LABELLED:
        parts = [re.fullmatch(r"([+-])(\d+)/(\d+)([af]?)", block).groups() for block in page.split()]
        rows = described([(int(w), int(linked), MARKS[mark]) for _, w, linked, mark in parts])
        out += [(*row, int(sign == "+")) for row, (sign, *_) in zip(rows, parts, strict=True)]
    return tuple(out)


def fit_tree(rows: tuple | None = None, depth: int = 10):
    """A binary tree by Gini impurity: (feature, bound, below or at, above), or 0 or 1 at a leaf."""
    rows = labelled() if rows is None else rows
    labels = [r[-1] for r in rows]
    if depth == 0 or len(set(labels)) == 1:
        return int(2 * sum(labels) > len(labels))

    def impurity(part: list) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            bound = (a + b) / 2
            low, high = [r for r in rows if r[f] <= bound], [r for r in rows if r[f] > bound]
            cost = impurity(low) + impurity(high)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, bound, low, high)
    if best is None:
        return int(2 * sum(labels) > len(labels))
    _, f, bound, low, high = best
    return (f, bound, fit_tree(tuple(low), depth - 1), fit_tree(tuple(high), depth - 1))


def decide(tree, row: tuple) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def asked(tree, row: tuple) -> list[str]:
    """The features on which a block's decision rests, from the root down."""
    out = []
    while isinstance(tree, tuple):
        out.append(FEATURES[tree[0]])
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return out


@lru_cache(maxsize=4096)
def _hinted(attributes: str, tag: str) -> bool:
    """Whether class, id or role name page furniture, or the element is hidden.

    Words for furniture count whatever else the name holds, but for the header of a text. An article is furniture
    only as a comment.
    """
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTES.findall(attributes)}
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")) or found.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes):
        return True
    names = set(re.split(r"[^a-z]+", " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()))
    found = names & (_COMMENT_HINTS if tag in ("article", "main") else _HINTS)
    return bool(found - {"header"} if tag in _INLINE or names & _CONTENT_HINTS else found)


def pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """The page in pieces: ("text", "", characters), ("open", element, attributes) and ("close", element, "").

    What is left open by mistake hides no text: a comment, a quoted value or a silent element without its end
    is taken as if it were not there (a script or style, up to the next element that ends a block). Every failed
    search is remembered, so time grows in proportion to the page, whatever it holds.
    """
    at, quoted, never, crossed = 0, True, set(), set()

    def find(what: str, start: int) -> int:
        i = -1 if what in never else html.find(what, start)
        if i < 0:
            never.add(what)
        return i

    def end_of(tag: str, start: int) -> int:
        """Where a silent element ends: at its own end tag, at the next one if they do not match, or nowhere."""
        if tag in never:
            return -1
        if tag in SILENT and tag not in crossed:
            depth = 1
            for m in _BOTH[tag].finditer(html, start):
                depth += -1 if m.group(1) else 0 if tag == "button" or m.group().endswith("/>") else 1
                if not depth:
                    return m.end()
            crossed.add(tag)
        m = _END[tag].search(html, start)
        if not m:
            never.add(tag)
        return m.end() if m else -1

    def end_of_tag(start: int) -> int:
        nonlocal quoted
        while quoted:
            m = _IN_TAG.search(html, start)
            if not m:
                quoted = False
                break
            start = m.end()
            if m.group() == ">":
                return m.start()
            before = m.start() - 1
            while html[before].isspace():
                before -= 1
            if html[before] == "=" and (shut := find(m.group(), start)) >= 0:
                start = shut + 1
        return find(">", start)

    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            yield "text", "", html[at:]
            return
        if start > at:
            yield "text", "", html[at:start]
        then = html[start + 1 : start + 2]
        name = _NAME.match(html, start + 2 if then == "/" else start + 1)
        if html.startswith("<!--", start) and (end := find("-->", start + 4)) >= 0:
            at = end + 3
        elif html.startswith("<![CDATA[", start) and (end := find("]]>", start)) >= 0:
            at = end + 3
        elif then and then in "!?" and (end := find(">", start)) >= 0:
            at = end + 1
        elif name and then == "/" and (end := find(">", name.end())) >= 0:
            at = end + 1
            yield "close", name.group().lower(), ""
        elif name and then != "/" and (end := (end_of_tag if quoted else lambda i: find(">", i))(name.end())) >= 0:
            tag, attributes, at = name.group().lower(), html[name.end() : end], end + 1
            yield "open", tag, attributes
            if (tag in RAW or tag in SILENT) and not (attributes.endswith("/") and tag == "svg"):
                shut = end_of(tag, at)
                if shut < 0 and tag in ("script", "style"):
                    m = _BLOCK_TAG.search(html, at)
                    shut = m.start() if m else len(html)
                at = max(at, shut)
        else:
            yield "text", "", "<"
            at = start + 1


def blocks(html: str) -> list[tuple[str, int, int, int]]:
    """The text blocks of a page in order: text, words, words inside links, mark (1 article, -1 furniture, 0 neither)."""
    out: list[tuple[str, int, int, int]] = []
    text: list[str] = []
    linked: list[str] = []
    # element, and as it is around it: mark, whether page furniture for good, whether the header of an article
    stack: list[tuple[str, int, bool, bool]] = []
    region, barred, titled, links = 0, False, False, 0
    own, heading, inside = False, False, []  # of the open block: named as furniture, a heading, open elements named as furniture

    def end() -> None:
        nonlocal own, heading
        words = unescape("".join(text)).split()
        if words:
            mark = -1 if barred or own else 1 if titled and heading else region
            out.append((" ".join(words), len(words), min(len(words), len(unescape(" ".join(linked)).split())), mark))
        text.clear()
        linked.clear()
        inside.clear()
        own = heading = False

    for kind, tag, value in pieces(html):
        if kind == "text":
            if inside:
                continue
            text.append(value)
            if links:
                linked.append(value)
        elif kind == "open":
            if tag in RAW or tag in SILENT or tag == "br":
                text.append(" ")
            elif tag == "a":
                links += 1
            if tag in _INLINE and (inside and tag == inside[-1] or value and _hinted(value, tag)):
                inside.append(tag)
            if tag not in BLOCKS:
                continue
            end()
            links = 0
            if tag in NESTED:
                stack.append((tag, region, barred, titled))
                if tag in ("article", "main"):
                    region, titled = 1, False
                elif tag in _SOFT_CHROME:
                    region, titled = -1, tag == "header" and region == 1
                if tag in _CHROME or tag not in ("body", "main") and value and _hinted(value, tag):
                    barred = True
            else:
                heading, own = tag in _HEADINGS, bool(value) and _hinted(value, tag)
        else:
            if tag == "a":
                links = max(0, links - 1)
            if inside and tag == inside[-1]:
                inside.pop()
            if tag not in BLOCKS:
                continue
            end()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    _, region, barred, titled = stack[i]
                    del stack[i:]
                    break
    end()
    return out


def main_text(html: str, tree) -> str:
    """The blocks that the tree keeps, joined by line feeds."""
    found = blocks(html)
    rows = described([b[1:] for b in found])
    return "\n".join(b[0] for b, row in zip(found, rows, strict=True) if decide(tree, row))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the html of each row by text and n_chars, its length in code points.

    Null and empty pages, and pages of which nothing is kept, give an empty text. Repeated rows stay. A page of
    any length is read whole, in time in proportion to it. An empty table gives an empty result. Columns named
    like a result are replaced.
    """
    tree = fit_tree()

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((main_text(x.as_py() or "", tree) for x in batch), pa.string())

    rest = [c for c in pages.columns if c != html and c.lower() not in ("text", "n_chars")]
    out = pages.select(*rest, texts.asNondeterministic()(html).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
