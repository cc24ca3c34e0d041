"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text in page order. A classifier gives each block a score: its cost of being called boilerplate if
positive, content if negative. These are the capacities to the two terminals. Smoothness edges join blocks that are adjacent,
and blocks that follow one another in the same parent, with capacities that fall with their distance in the DOM. The maximum
flow's cut separates content from boilerplate at the least total cost.

The classifier is logistic in features of a block: its text, its place, and what the elements and names around it tell, each
with a weight of its own. The weights start from a prior and are fitted on pages without labels, in turns: a minimum cut
labels the blocks, and the weights are fitted to these labels, drawn towards the prior. Costs are bounded and of the size of
the smoothness edges, so neither a name nor an element decides a block alone: long unlinked text and its neighbours can
outweigh them.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of the lowest hashes of page_id that the classifier is trained on at most. All pages are extracted.
TRAINING_PAGES = 400
#: The bound on what the classifier costs a block.
COST = 4.0
#: Capacity between adjacent blocks of one parent, and how much of it is left per step in the DOM.
SMOOTH, FADE = 1.5, 0.4

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?…]")

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title svg annotation iframe object embed canvas audio video select option datalist head".split())
#: Of these, the ones whose content is not markup, so that only their own end tag ends them.
LITERAL = frozenset("script style textarea title noscript iframe template svg annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose attributes are not looked at.
INLINE = frozenset("b i em strong span u s small font code sup sub q cite mark abbr time".split())
#: Elements that need no end tag.
IMPLIED = frozenset("p li dt dd option tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TELLS = re.compile(r"\b(?:class|id|role|hidden|style)\b", re.I)
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset search".split())
CONTENT = frozenset("article main".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies "
    "consent gdpr notice notices alert popup modal overlay nav navbar navigation navigator menu menus breadcrumb breadcrumbs pagination pager "
    "sidebar sidebars side rail widget widgets footer foot header masthead topbar toolbar share sharing social related recommended "
    "recommendations comment comments commentlist discussion feedback disqus replies reply respond respondents responses subscribe subscription newsletter signup login "
    "search searchform copyright legal disclaimer skip tags".split()
)
GOOD_NAMES = frozenset("article content post entry story articlebody body main text".split())
#: What follows these in a name tells the layout ("has-sidebar"), not what the element holds.
MODIFIERS = frozenset("has no with without".split())
#: The classifier's features, and the weights from which fitting starts and towards which it is drawn.
FEATURES = {
    "one": -3.0,
    "length": 0.7,  # log of the characters
    "linked": -4.0,  # part of the characters that are links
    "punctuation": 2.0,  # marks per word
    "word_length": 0.0,
    "long": 1.0,  # 12 words or more
    "boilerplate": -4.0,  # within an element or role such as nav
    "named": -2.0,  # within an element whose name tells boilerplate, no content within
    "content": 3.0,  # within an element or role that marks content, or of such a name
    "outside": -2.5,  # not so, on a page that marks content elsewhere
    "heading": 0.5,
    "late": 0.0,  # place on the page, from 0 to 1
}
#: How many times the blocks are labelled and the weights fitted, and how strongly the prior holds.
TURNS, PRIOR = 3, 0.02


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    bad: bool  # by an element or role
    named: bool  # by a telling name
    good: bool
    hidden: bool
    within: int = 0  # open elements of the same tag inside that are no Element


@dataclass
class Block:
    text: str
    element: Element
    linked: int  # characters within links

    @property
    def content(self) -> bool:
        e = self.element
        return e.good and not e.bad and not e.named

    def features(self, marked: bool, place: float) -> list[float]:
        """FEATURES in turn; ``marked``: some block of the page is content by its elements."""
        t, n, e = self.text, len(self.text), self.element
        words = t.count(" ") + 1
        text = [1.0, math.log(n + 1), self.linked / max(n, 1), min(len(_PUNCT.findall(t)) / words, 1.0), min(n / words, 12.0) / 12, float(words >= 12)]
        return [*text, float(e.bad), float(e.named), float(self.content), float(marked and not self.content), float(e.tag in HEADINGS), place]


def _named(values: list[str], inside: bool) -> tuple[bool, bool]:
    """(bad, good) by the names of an element; a bad name and a good one beside it cancel out."""
    bad = good = False
    for name in " ".join(values).split():
        words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w]
        words = words[: next((k for k, w in enumerate(words) if w in MODIFIERS), len(words))]
        if words and words[-1] == "none":
            continue
        names = set(words)
        telling = names & BAD_NAMES
        if inside or names & (GOOD_NAMES - {"main", "body"}):
            telling = telling - {"header"}  # an article's header holds its title; "main-header" is the page's
        bad, good = bad or bool(telling), good or (not telling and bool(names & GOOD_NAMES))
    return bad and not good, good and not bad


def _element(tag: str, attrs: str, parent: Element | None) -> Element:
    bad, good, hidden = tag in BOILERPLATE, tag in CONTENT, False
    marked, sole, values = good, tag == "main", []  # sole: the one content of its page
    inside = parent is not None and parent.good
    if tag == "header" and not inside:
        bad = True
    if attrs.strip():
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), unescape(value.strip("\"'"))
            if name in ("class", "id"):
                values.append(value)
            elif name == "role":
                bad, marked, sole = bad or value.lower() in BAD_ROLES, marked or value.lower() in ("main", "article"), sole or value.lower() == "main"
            elif name == "itemprop":
                if value.lower() == "articlebody":
                    marked = sole = True
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                hidden = True
            elif name == "style":
                hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    named, fine = _named(values, inside) if values else (False, False)
    # names of the page's own frame ("main-header") say nothing on html and body
    free = tag in ("html", "body", "article", "main")
    good = good or marked or (fine and not bad and not free)
    if parent is not None:
        # content resets a name around it, but an article none within other content: comments can be articles, too
        kept = parent.named and (named or not (sole or (marked and not inside)))
        e = parent if tag == "article" else None
        while e is not None and e.tag != "article":
            e = e.parent
        kept = kept or e is not None  # an article's own articles are its comments
        bad, named, good, hidden = bad or parent.bad, kept or (named and not free), good or parent.good, hidden or parent.hidden
    return Element(tag, parent, parent.depth + 1 if parent else 0, bad, named, good, hidden)


def blocks(html: str) -> list[Block]:
    """Blocks of text in page order, character references decoded and white space within each made one space."""
    out: list[Block] = []
    here = _element("html", "", None)
    buffer: list[str] = []
    linked, in_link, at, size = 0, 0, 0, len(html)

    def end_block() -> None:
        nonlocal buffer, linked
        if buffer:
            text = _SPACE.sub(" ", unescape("".join(buffer))).strip()
            if text and not here.hidden:
                out.append(Block(text, here, min(linked, len(text))))
        buffer, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            buffer.append(text)
            if in_link:
                linked += len(text.strip())

    def opened(tag: str) -> Element | None:
        """The open element of a tag that is no block, which blocks in need of an end tag shield."""
        e = here
        while e is not None and e.tag != tag and (e.tag not in BLOCK or e.tag in IMPLIED):
            e = e.parent
        return e if e is not None and e.tag == tag and e.parent is not None else None

    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCK or tag in RAW:
                e = here
                while e is not None and e.tag != tag:
                    e = e.parent
                end_block()
                if e is not None and e.parent is not None:
                    here = e.parent
            elif tag not in INLINE and (e := opened(tag)) is not None:
                if e.within:
                    e.within -= 1
                else:
                    end_block()
                    here = e.parent
            continue
        if tag in LITERAL and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            buffer.append(" ")
        elif tag == "a":
            in_link += 1
        elif tag in RAW:
            if tag not in VOID:
                end = re.compile(rf"</{tag}\s*>" + (r"|(?=<body\b)" if tag == "head" else ""), re.I).search(html, at)
                at = end.end() if end else at
        elif tag in BLOCK:
            end_block()
            if tag not in VOID:
                while here.tag == "p" or (here.tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    here = here.parent  # an open paragraph ends where a block starts
                here = _element(tag, m[3], here)
        elif tag not in VOID and tag not in INLINE and not m[3].endswith("/"):
            e = _element(tag, m[3], here) if _TELLS.search(m[3]) else here
            # only what tells it from the text around ends a block
            if (e.bad, e.named, e.hidden) != (here.bad, here.named, here.hidden) or ("-" in tag and e.good != here.good):
                end_block()
                here = e
            elif (e := opened(tag)) is not None:
                e.within += 1
    end_block()
    return out


def _distance(a: Element, b: Element) -> int:
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def edges(page: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: adjacent blocks, and consecutive blocks of one parent that others stand between."""
    out, last = [], {}
    for k, b in enumerate(page):
        if k:
            out.append((k - 1, k, SMOOTH * FADE ** max(0, _distance(page[k - 1].element, b.element) - 2)))
        parent = id(b.element.parent)
        if parent in last and last[parent] < k - 1:
            out.append((last[parent], k, SMOOTH * FADE))
        last[parent] = k
    return out


def min_cut(score: list[float], joins: list[tuple[int, int, float]]) -> list[bool]:
    """True for blocks on the source's side of a minimum cut: capacity score to the source or -score to the sink.

    Dinic's algorithm. Every block has one terminal edge, so a path runs from a block with excess to one with deficit.
    """
    n = len(score)
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in joins:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(c)
    excess, deficit, tiny = [max(s, 0.0) for s in score], [max(-s, 0.0) for s in score], 1e-9
    while True:
        level = [-1] * n
        todo = deque(k for k in range(n) if excess[k] > tiny)
        for k in todo:
            level[k] = 0
        found = False
        while todo:
            u = todo.popleft()
            found = found or deficit[u] > tiny
            for e in out[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    todo.append(to[e])
        if not found:
            return [x >= 0 for x in level]
        arc = [0] * n
        for s in range(n):
            while excess[s] > tiny and level[s] == 0:
                path, u = [], s
                while deficit[u] <= tiny:
                    while arc[u] < len(out[u]):
                        e = out[u][arc[u]]
                        if cap[e] > tiny and level[to[e]] == level[u] + 1:
                            break
                        arc[u] += 1
                    else:
                        if not path:
                            break
                        e = path.pop()
                        u = to[e ^ 1]
                        arc[u] += 1
                        continue
                    path.append(e)
                    u = to[e]
                if deficit[u] <= tiny:
                    break
                push = min([excess[s], deficit[u], *[cap[e] for e in path]])
                excess[s] -= push
                deficit[u] -= push
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push


UNTRAINED = tuple(FEATURES.values())


def matrix(page: list[Block]) -> np.ndarray:
    marked = any(b.content for b in page)
    return np.array([b.features(marked, k / len(page)) for k, b in enumerate(page)])


def scores(x: np.ndarray, weights: tuple[float, ...]) -> list[float]:
    return np.clip(x @ np.array(weights), -COST, COST).tolist()


def label(page: list[Block], weights: tuple[float, ...], x: np.ndarray | None = None) -> list[bool]:
    """Whether each block is content."""
    return min_cut(scores(matrix(page) if x is None else x, weights), edges(page))


def extract(html: str, weights: tuple[float, ...] = UNTRAINED) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, k in zip(page, label(page, weights)) if k) if page else ""


def fit(htmls: list[str], turns: int = TURNS) -> tuple[float, ...]:
    """Weights from unlabelled pages; UNTRAINED if there are none, or if all their blocks look alike."""
    pages = [(page, matrix(page)) for page in map(blocks, htmls) if page]
    weights = UNTRAINED
    for _ in range(turns if pages else 0):
        y = np.array([k for page, x in pages for k in label(page, weights, x)], float)
        if y.min() == y.max():
            return UNTRAINED
        weights = _logistic(np.concatenate([x for _, x in pages]), y, np.array(weights))
    return weights


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 100) -> tuple[float, ...]:
    """Logistic regression by Newton's method, both classes of the same weight, with a ridge around UNTRAINED."""
    share, prior = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())), np.array(UNTRAINED)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + PRIOR * (w - prior)
        curve = x.T @ (x * (share * p * (1 - p))[:, None]) + PRIOR * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = TRAINING_PAGES) -> tuple[float, ...]:
    h = F.xxhash64(F.col(id_col).cast("string"))
    low = pages.select(h.alias("h")).orderBy("h").limit(rows).collect()
    if not low:
        return UNTRAINED
    got = pages.where(h <= F.lit(low[-1].h)).select(h.alias("h"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("t")).limit(rows).collect()
    return fit([t for _, t in sorted(map(tuple, got))])


def _extracted(weights: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, weights) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row, in one pass without a shuffle.

    Null or empty html, and a page without content, give an empty text. Repeated rows each get their row; null page_ids and
    urls stay null; an empty table gives an empty result; other columns are ignored.
    """
    weights = train(pages, id_col, html_col)
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(_extracted(weights), "page_id long, url string, text string, n_chars long")
