"""Main text of web pages by minimum cut.

A page is cut into blocks of text at block-level tags, and around inline elements that are
marked as boilerplate. A linear classifier on a block's surroundings (elements it lies in and
their class names, link share, length, sentence marks) gives the cost of calling it content
or boilerplate; these become the capacities from the two terminals. Blocks that follow each
other are tied, the more the closer they are in the element tree, and so is each block to
the one before it in the same parent and in the same grandparent, wherever that stands in
the page. The minimum cut of this network labels all blocks of the page at once.

Class names are read word by word: a name marks boilerplate by its first or last word and
unless another word says that it is about the layout (`has-sidebar`). What marks an element
that holds the page's main article says nothing about the article, and is left out.

Scripts, styles, comments, head matter and form controls hold no text. Character
references are decoded, white space inside a block becomes one space, and content blocks
are joined in page order by one space. Tags are read in one pass, in time linear in the page.

Cases: null, empty and text-free pages give an empty text; unclosed and crossed tags are
closed by their ancestors; a tag that the page ends in is no text; a page of plain text is
one block. Repeated rows come out once each; other columns are ignored, and kept ones that
have the name of an output are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.lineage import free_names

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_PLAIN = re.compile(r"[^>\"']*")
_RAW = frozenset("script style noscript template svg iframe object canvas select textarea button title".split())
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACES = re.compile(r"\s+")

_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_BAD_TAGS = {"nav": -6.0, "footer": -6.0, "header": -3.0, "aside": -6.0, "form": -6.0, "menu": -6.0, "dialog": -6.0, "fieldset": -4.0, "figcaption": -0.5, "head": -9.0}
_GOOD_TAGS = {"article": 3.0, "main": 3.0, "p": 1.5, "h1": 1.0, "h2": 0.7, "h3": 0.5, "blockquote": 0.7, "pre": 0.7}
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login"
    " nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead sidebar side widget widgets related recommended recommendations share sharing social comment comments disqus replies respond"
    " pagination pager toolbar search tags legal copyright skip".split()
)
#: Words of a name that is about the layout around something.
_LAYOUT_WORDS = frozenset("no not has have with without is layout page single wrapper container grid row col column".split())
_GOOD_WORDS = frozenset("article content entry post story main body text".split())
_COMMENTS = frozenset("comment comments disqus replies respond".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

#: Weight of the tie between neighbouring blocks, how fast it fades with their distance in the tree, and the share of it between blocks of one parent or grandparent that are apart in the page.
TIE, FADE, APART = 1.2, 0.5, 0.4


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "/" of an end tag, lower-case name, attributes) of each tag, and of the rest of the page without a name.

    A `>` inside quotes does not end a tag, unless the page has none outside quotes any more.
    """
    at = text_from = 0
    last, quoted = page.rfind(">"), True
    while True:
        at = page.find("<", at)
        if at < 0:
            yield page[text_from:], "", "", ""
            return
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield page[text_from:at], "", "", ""
            text_from = at = len(page) if end < 0 else end + 3
            continue
        m = _TAG.match(page, at)
        if not m and page[at + 1 : at + 2] not in ("!", "?"):
            at += 1
            continue
        if at > last:
            yield page[text_from:at], "", "", ""
            return
        if not m:
            end = page.find(">", at)
            yield page[text_from:at], "", "", ""
            text_from = at = end + 1
            continue
        end = m.end()
        while quoted:
            end = _PLAIN.match(page, end).end()
            if end >= len(page):
                quoted = False
            elif page[end] == ">":
                break
            else:
                end = page.find(page[end], end + 1) + 1
                quoted = end > 0
        if not quoted:
            end = page.find(">", m.end())
        name = m[2].lower()
        yield page[text_from:at], m[1], name, page[m.end() : end]
        text_from = at = end + 1
        if name in _RAW and not m[1]:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            text_from = at = close.end() if close else len(page)


def _named(value: str) -> tuple[float, bool, bool]:
    """Boilerplate evidence of a class or id, whether it is about comments, and whether it speaks for content."""
    bad, comments, good = 0.0, False, False
    for name in value.split():
        words = [w.lower() for w in _NAME_WORD.findall(name)]
        if not words:
            continue
        layout = any(w in _LAYOUT_WORDS for w in words)
        marked = {words[0], words[-1]} & _BAD_WORDS
        if marked and not layout:
            bad, comments = -6.0, comments or bool(marked & _COMMENTS)
        elif not layout and _GOOD_WORDS.intersection(words):
            good = True
    return bad, comments, good


class _Element:
    __slots__ = ("at", "bad", "comments", "depth", "good", "inline", "inner", "name", "size", "up")

    def __init__(self, name: str, attributes: str, inline: bool = False):
        self.name, self.inline, self.inner, self.size, self.at, self.up, self.depth = name, inline, 0, 0, 0, 0, 0
        self.bad, self.good, self.comments = _BAD_TAGS.get(name, 0.0), _GOOD_TAGS.get(name, 0.0), False
        if attributes:
            for a in _ATTRIBUTE.finditer(attributes):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id"):
                    bad, comments, good = _named(value)
                    if name not in ("body", "html"):
                        self.bad += bad
                        self.comments |= comments
                    if good:
                        self.good = max(self.good, 2.0)
                elif key == "role" and value.lower() in _BAD_ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    self.bad -= 6.0


def blocks_of(page: str) -> tuple[list[tuple[str, int, int, float, float]], list[_Element]]:
    """(text, linked characters, element, boilerplate evidence, content evidence) of each block, and the elements, parents first."""
    found: list[tuple[str, int, int]] = []
    elements = [_Element("", "")]
    stack = [elements[0]]
    in_stack: dict[str, int] = {}
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if text:
            t = _SPACES.sub(" ", html.unescape("".join(text))).strip()
            if t:
                found.append((t, linked, stack[-1].at))
            text.clear()
        linked = 0

    def opened(name: str, attributes: str, inline: bool = False) -> None:
        e = _Element(name, attributes, inline)
        e.at, e.up, e.depth = len(elements), stack[-1].at, stack[-1].depth + 1
        elements.append(e)
        stack.append(e)
        in_stack[name] = in_stack.get(name, 0) + 1

    def close(i: int) -> None:
        for e in stack[i:]:
            in_stack[e.name] -= 1
        del stack[i:]

    for before, closing, name, attributes in tokens(page):
        if before:
            text.append(before)
            if links:
                linked += len(before)
        if not name:
            continue
        if name in _INLINE:
            if name == "a":
                links = max(0, links - 1) if closing else links + 1
            elif name == "br":
                text.append(" ")
            top = stack[-1]
            if top.inline and top.name == name:
                top.inner += -1 if closing else 1
                if top.inner < 0:
                    flush()
                    close(len(stack) - 1)
            elif attributes and not closing and name not in _VOID and _Element(name, attributes).bad <= -6.0:
                flush()
                opened(name, attributes, inline=True)
            continue
        flush()
        links = 0
        if closing:
            if in_stack.get(name):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name in _VOID:
            continue
        if name in _ENDS_P or name == "li":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == ("li" if name == "li" else "p"):
                    close(i)
                    break
                if not stack[i].inline and stack[i].name not in ("p", "li"):
                    break
        opened(name, attributes)
    flush()
    return _with_evidence(found, elements), elements


def _with_evidence(found: list[tuple[str, int, int]], elements: list[_Element]) -> list[tuple[str, int, int, float, float]]:
    """The blocks with the evidence of their elements; what marks an element around the main article says nothing about it."""
    for t, linked, at in found:
        elements[at].size += len(t) - min(linked, len(t))
    for e in reversed(elements[1:]):
        elements[e.up].size += e.size
    for e in elements[1:]:
        e.comments |= elements[e.up].comments
    articles = [e for e in elements if e.name in ("article", "main") and e.size and e.bad > -6.0 and not e.comments]
    if articles:
        e = max(articles, key=lambda e: (e.name == "main", e.size))
        while e.at:
            e = elements[e.up]
            e.bad = max(e.bad, 0.0)
    for e in elements[1:]:
        up = elements[e.up]
        e.bad += up.bad
        e.good = up.good + 1.5 if e.name == "p" else max(up.good, e.good)
    return [(t, linked, at, elements[at].bad, elements[at].good) for t, linked, at in found]


def costs(block: tuple[str, int, int, float, float]) -> float:
    """The classifier's log-odds that a block is content."""
    text, linked, _, bad, good = block
    n = len(text)
    odds = -1.0 + good + bad
    odds += 0.35 * math.log1p(n / 40)
    odds -= 3.0 * (min(linked, n) / n if linked else 0.0)
    if text[-1:] in ".!?:;\"')”»。！？":
        odds += 0.6
    if "©" in text:
        odds -= 2.0
    return odds


def min_cut(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source (content) in a minimum cut; max-flow by shortest augmenting paths."""
    n = len(odds)
    source, sink = n, n + 1
    to: list[list[int]] = [[] for _ in range(n + 2)]
    cap: list[float] = []
    head: list[int] = []

    def edge(a: int, b: int, c: float, back: float) -> None:
        to[a].append(len(head))
        head.append(b)
        cap.append(c)
        to[b].append(len(head))
        head.append(a)
        cap.append(back)

    for i, x in enumerate(odds):
        if x > 0:
            edge(source, i, x, 0.0)
        elif x < 0:
            edge(i, sink, -x, 0.0)
    for a, b, c in ties:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in to[a]:
                if cap[e] > 1e-12 and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= least
                    cap[e ^ 1] += least
                full = next(k for k, e in enumerate(path) if cap[e] <= 1e-12)
                a = head[path[full] ^ 1]
                del path[full:]
                continue
            while turn[a] < len(to[a]):
                e = to[a][turn[a]]
                if cap[e] > 1e-12 and level[head[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                a = head[path.pop() ^ 1]
                continue
            path.append(to[a][turn[a]])
            a = head[to[a][turn[a]]]


def ties_of(places: list[int], elements: list[_Element]) -> list[tuple[int, int, float]]:
    """Smoothness edges between blocks in these elements: of blocks that follow each other, and of blocks of one parent or grandparent."""

    def apart(a: int, b: int) -> int:
        steps = 0
        while a != b:
            if elements[a].depth < elements[b].depth:
                a, b = b, a
            a = elements[a].up
            steps += 1
        return steps

    out = [(i, i + 1, TIE * math.exp(-FADE * apart(places[i], places[i + 1]))) for i in range(len(places) - 1)]
    last: dict[tuple[int, int], int] = {}
    for i, at in enumerate(places):
        up = at
        for steps in (1, 2):
            if not up:
                break
            up = elements[up].up
            if last.get((steps, up), i - 1) < i - 1:
                out.append((last[steps, up], i, APART * TIE * math.exp(-FADE * 2 * steps)))
            last[steps, up] = i
    return out


def extract(page: str | None) -> str:
    """The main text of one page."""
    blocks, elements = blocks_of(page or "")
    if not blocks:
        return ""
    odds = [costs(b) for b in blocks]
    ties = ties_of([b[2] for b in blocks], elements)
    # Neighbours of one sign that a tie cannot part need no network.
    if all(x > 0 for x in odds) or all(x < 0 for x in odds):
        keep = [odds[0] > 0] * len(odds)
    else:
        keep = min_cut(odds, ties)
    return " ".join(b[0] for b, k in zip(blocks, keep, strict=True) if k)


def extract_text(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` with text and n_chars."""
    keep = [c for c in keep if c.lower() not in ("text", "n_chars")]
    (whole,) = free_names(keep, "html")
    src = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_column}`").cast("string").alias(whole))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                texts = [extract(x) for x in batch.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return src.mapInArrow(run, f"{schema}, text string, n_chars long")


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
