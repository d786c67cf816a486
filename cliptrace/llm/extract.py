"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks with a tree of elements above them.  A
logistic classifier gives each block its log odds of being article text, from
its words and links, the elements above it and their names.  The odds are the
block's terminal capacity: to the article as its source, or against it to the
sink.  Smoothness edges join neighbours in page order and neighbours under one
parent, weaker the farther apart two blocks stand in the tree.  The minimum cut,
found by max-flow, separates content from boilerplate: a block that its own odds
would lose is kept among article text, and one that they would keep goes with
the boilerplate around it, unless its odds outweigh its neighbours.

The classifier is fitted on blocks of pages that mark their article up
(``fit``); the mark itself is no feature of it.  A Gaussian prior around stated
weights holds what those pages do not show.  Fitted on a bounded sample
(``MAX_PAGES``); extraction reads every page whole.

A null or empty page has the empty text; repeated rows are extracted alike; an
empty table stays empty; pages of any length and depth are read in time about
proportional to their length.  A column of the output's name is replaced.
"""

from __future__ import annotations

import html
import math
import re
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut as written_table
from .common import drawn, only

# Element names of HTML, by what they do to text.
_RAW = frozenset("script style noscript template title iframe textarea".split())
_UNSHOWN = frozenset("script style noscript template head title iframe select option datalist button textarea".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br nobr input link meta".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_APART = frozenset("nav footer aside form menu dialog fieldset".split())
_TEXT = frozenset("p pre blockquote figcaption td".split())
_HEADING = frozenset("h1 h2 h3 h4".split())
_LIST = frozenset("li dt dd".split())
# Words of class, id and role names.
_GOOD = frozenset("article articlebody content story post entry text main body prose".split())
_BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promoted promotion promotions nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar rail aside widget widgets header masthead topbar footer foot copyright comment comments discussion disqus reply replies respond reviews cookie cookies consent gdpr notice notices "
    "notification alert disclaimer popup modal overlay dialog login signin signup subscribe subscription newsletter share sharing social related recommended recommendations trending tags pagination "
    "pager toolbar complementary contentinfo".split()
)
_DOUBTFUL = frozenset("side bottom legal form search results more popular tag skip".split())
_NAME_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_END = {t: re.compile(rf"</{t}\s*[^>]*(?:>|\Z)", re.I) for t in _RAW}

#: Strength of the edges between neighbours in page order, and under one parent.
NEXT_EDGE, SIBLING_EDGE = 0.8, 1.5
#: Share of an edge that is left between a plain block and one that is not.
ACROSS = 0.15
#: Log odds that a block's place inside, or outside, the marked-up article adds.
INSIDE, OUTSIDE = 2.0, -3.0
#: Largest capacity of a block.
CAPACITY = 8.0
#: Share of a page's text from which an element frames the page: its name and
#: kind then say nothing of what stands in it.
FRAME = 0.8
#: Steps up the tree within which two blocks are near.
NEAR = 16
#: Pages that the classifier is fitted on, about, whatever their number.
MAX_PAGES = 2_000
#: Blocks that the fitting pages count for against the prior.
EVIDENCE = 200.0
FEATURES = ["constant", "log_words", "linked", "sentence_end", "text_element", "heading", "list_item", "apart_element", "header_element", "bad_name", "doubtful_name", "good_name"]
# Means of the prior of the weights, in the order of FEATURES.
PRIOR = np.array([0.3, 0.6, -3.5, 0.8, 0.8, 0.6, -0.5, -7.0, -5.0, -7.0, -2.2, 1.5])


@dataclass
class Page:
    """Elements as arrays (parents before children), and the text blocks."""

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    names: list[int] = field(default_factory=lambda: [0])  # bits: 1 bad, 2 doubtful, 4 good
    node: list[int] = field(default_factory=list)  # of each block
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters in links


def _names(attrs: str) -> int:
    if not attrs or "=" not in attrs:
        return 0
    out = 0
    for m in _ATTR.finditer(attrs):
        words = set(_NAME_WORDS.findall(_CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower()))
        good, bad = words & _GOOD, words & _BAD
        if good and bad <= {"header"}:
            bad = set()  # the head of an article
        out |= 1 if bad else 4 if good else 0
        out |= 2 if not bad and words & _DOUBTFUL else 0
    return out


def blocks(page: str) -> Page:
    """The elements and text blocks of a page, in order."""
    out = Page()
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element, whether it is never shown
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked, in_link, at, size = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.node.append(stack[-1][1])
                out.text.append(text)
                out.linked.append(linked)
            parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if not stack[-1][2] and raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text)

    def leave(n: int) -> None:
        for tag, _, _ in stack[n:]:
            opened[tag] -= 1
        del stack[n:]

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        m = _TAG.match(page, lt)
        if m is None:  # a lone "<" is text
            say(page[at : lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                say(" ")
            continue
        flush()
        if not closing:
            if tag in _RAW:
                end = _END[tag].search(page, at)
                at = end.end() if end else size
                continue
            if tag in _CLOSES_P and stack[-1][0] == "p" or tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack[-1][0] == tag:
                leave(len(stack) - 1)
            if tag in _VOID:
                continue
            out.parent.append(stack[-1][1])
            out.tag.append(tag)
            out.names.append(_names(attrs))
            opened[tag] = opened.get(tag, 0) + 1
            stack.append((tag, len(out.parent) - 1, stack[-1][2] or tag in _UNSHOWN))
        else:
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                leave(k)
            in_link = 0
    flush()
    return out


def describe(p: Page) -> tuple[np.ndarray, np.ndarray, bool]:
    """Features of each block, whether it stands in the marked-up article, and
    whether the page has one."""
    n = len(p.parent)
    own = [0] * n  # text outside links, below each element
    for k, t, linked in zip(p.node, p.text, p.linked, strict=True):
        own[k] += max(0, len(t) - linked)
    for k in range(n - 1, 0, -1):
        own[p.parent[k]] += own[k]
    frame = [k == 0 or p.tag[k] in ("html", "body") or own[0] > 0 and own[k] >= FRAME * own[0] for k in range(n)]
    # The article with most text, or main: what holds it frames the page too.
    marked = [k for k in range(1, n) if p.tag[k] in ("article", "main") and not p.names[k] & 1 and own[k]]
    if marked:
        k = max(marked, key=lambda k: (p.tag[k] == "main", own[k], -k))
        while k:
            k = p.parent[k]
            frame[k] = True
    # What each element passes on: [apart, header, bad, doubtful, good, article].
    apart, header, bad, doubtful, good, inside = ([False] * n for _ in range(6))
    for k in range(1, n):
        up, tag, names = p.parent[k], p.tag[k], 0 if frame[k] else p.names[k]
        inside[k] = inside[up] or tag in ("article", "main") and not p.names[k] & 1 and not apart[up] and not bad[up]
        apart[k] = apart[up] or tag in _APART and not frame[k]
        header[k] = header[up] or tag == "header" and not frame[k] and not inside[up]
        bad[k] = bad[up] or bool(names & 1)
        begins = tag in ("article", "main")  # names beyond its own article are not doubts of it
        doubtful[k] = bool(names & 2) or doubtful[up] and not begins
        good[k] = good[up] or bool(p.names[k] & 4)
    x = np.zeros((len(p.text), len(FEATURES)))
    for i, (k, text, linked) in enumerate(zip(p.node, p.text, p.linked, strict=True)):
        tag = p.tag[k]
        x[i] = (
            1, math.log((text.count(" ") + 1) / 8.0), min(1.0, linked / len(text)), text[-1] in ".!?…:;\"'»”", tag in _TEXT, tag in _HEADING, tag in _LIST,
            apart[k], header[k], bad[k], doubtful[k], good[k],
        )
    return x, np.array([inside[k] for k in p.node], bool), bool(marked)


class Network:
    """A flow network with undirected and terminal edges; Dinic's max-flow."""

    def __init__(self, n: int):
        self.n = n + 2
        self.to: list[int] = []
        self.cap: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(self.n)]

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(there)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(back)

    def levels(self, s: int) -> list[int]:
        level, todo = [-1] * self.n, deque([s])
        level[s] = 0
        while todo:
            a = todo.popleft()
            for e in self.out[a]:
                b = self.to[e]
                if level[b] < 0 and self.cap[e] > 1e-9:
                    level[b] = level[a] + 1
                    todo.append(b)
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        """Run max-flow; the nodes that the source still reaches."""
        to, cap, out = self.to, self.cap, self.out
        while (level := self.levels(s))[t] >= 0:
            nth = [0] * self.n
            path: list[int] = []
            a = s
            while True:
                if a == t:
                    flow = min(cap[e] for e in path)
                    back = len(path)
                    for k, e in enumerate(path):
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                        if cap[e] <= 1e-9 and k < back:
                            back = k
                    a = to[path[back] ^ 1]
                    del path[back:]
                    continue
                while nth[a] < len(out[a]):
                    e = out[a][nth[a]]
                    if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                        break
                    nth[a] += 1
                else:
                    if not path:
                        break
                    a = to[path.pop() ^ 1]
                    nth[a] += 1
                    continue
                path.append(e)
                a = to[e]
        return [x >= 0 for x in level]


def odds_of(p: Page, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds that each block is article text, and whether it is a plain one:
    no element above it stands apart by kind or name."""
    x, inside, marked = describe(p)
    plain = (x[:, 7:10] == 0).all(axis=1)
    # A place inside the marked-up article counts for plain blocks only.
    odds = x @ weights + (np.where(inside, np.where(plain, INSIDE, 0.0), OUTSIDE) if marked else 0.0)
    return np.clip(odds, -CAPACITY, CAPACITY), plain


def _apart(p: Page, depth: list[int], a: int, b: int) -> int:
    """Steps between two elements of the tree, ``2 * NEAR`` at most."""
    steps = 0
    while a != b and steps < 2 * NEAR:
        if depth[a] >= depth[b]:
            a = p.parent[a]
        else:
            b = p.parent[b]
        steps += 1
    return steps


def label(p: Page, odds: np.ndarray, plain: np.ndarray) -> list[bool]:
    """Which blocks are article text: the source's side of the minimum cut.

    Edges between a plain block and one that is not are weak: an advert amid
    paragraphs and the paragraphs do not hold each other.
    """
    n = len(odds)
    if (odds > 0).all() or (odds <= 0).all():
        return (odds > 0).tolist()
    depth = [0] * len(p.parent)
    for k in range(1, len(depth)):
        depth[k] = depth[p.parent[k]] + 1
    net, s, t = Network(n), n, n + 1
    last: dict[tuple[int, bool], int] = {}
    for i, x in enumerate(odds.tolist()):
        if x > 0:
            net.edge(s, i, x)
        elif x < 0:
            net.edge(i, t, -x)
        above = p.parent[p.node[i]], bool(plain[i])
        if i:
            w = NEXT_EDGE / (1 + _apart(p, depth, p.node[i - 1], p.node[i])) * (1.0 if plain[i] == plain[i - 1] else ACROSS)
            net.edge(i - 1, i, w, w)
        if above in last:
            net.edge(last[above], i, SIBLING_EDGE, SIBLING_EDGE)
        last[above] = i
    return net.source_side(s, t)[:n]


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """Article text of a page: its blocks in order, joined by one space."""
    if not page:
        return ""
    p = blocks(page)
    return " ".join(t for t, keep in zip(p.text, label(p, *odds_of(p, weights)), strict=True) if keep) if p.text else ""


def fit(pages: DataFrame, html_col: str = "html", rounds: int = 8) -> np.ndarray:
    """Weights of the classifier, from pages that mark their article up.

    Blocks inside the mark are article text, the others are not.  Newton's
    method; each round sums gradients and curvature by partition.  Pages without
    such a mark, or with nothing outside it, are left out; without any the prior
    stands.  Pages with equal hashes stand or fall together, so that the sample
    does not depend on the order of rows.
    """
    body = pages.select(F.col(html_col).alias("h"))
    some = body.filter(drawn(F.xxhash64("h"), MAX_PAGES, pages.count())).filter(F.lower("h").rlike("<(article|main)[ >]"))
    d = len(PRIOR)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch["h"].to_pylist():
                x, inside, marked = describe(blocks(page))
                if marked and inside.any() and not inside.all():
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]), pa.array([inside.tobytes()])], names=["x", "y"])

    table = written_table(some.select("h").repartition(8).mapInArrow(featured, "x binary, y binary"))
    w, n = PRIOR.copy(), None
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            gradient, curvature, count = np.zeros(d), np.zeros((d, d)), 0
            for batch in batches:
                for a, b in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                    x, y = np.frombuffer(a).reshape(-1, d), np.frombuffer(b, bool)
                    q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                    gradient += x.T @ (q - y)
                    curvature += (x * (q * (1 - q))[:, None]).T @ x
                    count += len(y)
            yield pa.RecordBatch.from_arrays([pa.array([gradient.tobytes()]), pa.array([curvature.tobytes()]), pa.array([count])], names=["g", "c", "n"])

        got = table.mapInArrow(sums, "g binary, c binary, n long").collect()  # one small row a partition
        n = sum(r["n"] for r in got)
        if not n:
            return PRIOR.copy()
        scale = min(1.0, EVIDENCE / n)
        gradient = scale * sum(np.frombuffer(r["g"]) for r in got) + (w - PRIOR)
        curvature = scale * sum(np.frombuffer(r["c"]).reshape(d, d) for r in got) + np.eye(d)
        step = np.linalg.solve(curvature, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def extract(pages: DataFrame, weights: np.ndarray | None = None, html_col: str = "html", out: str = "text") -> DataFrame:
    """Add the column ``out``: the article text of each page.

    ``weights`` are those of ``fit``; without them the prior decides.
    """
    given = (PRIOR if weights is None else np.asarray(weights)).tolist()
    tag = uuid.uuid4().hex

    @F.pandas_udf(T.StringType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = only(("extract", tag), lambda: np.array(given))
        for batch in batches:
            yield pd.Series([main_text(p, w) for p in batch.tolist()], dtype=object)

    return pages.withColumn(out, of(F.col(html_col)))
