"""Main text of web pages by a minimum cut.

A page is cut into blocks of text. A logistic classifier on a block's own features
(kind of enclosing elements, words in class and id, link density, length,
punctuation) gives the cost of calling it content or boilerplate; these are the
capacities to the two terminals. Neighbours in the page and blocks of the same
element are tied by smoothness edges. The minimum cut is the labelling of least
total cost; it is found by maximum flow.
"""

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.common import free_name, text_of

#: Quotes belong together only behind an equals sign; elsewhere they are signs like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|</?[a-zA-Z](?:[^>=]++|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|))*+(?:>|\Z)|[^<]+|<", re.S)
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: Elements whose text is never read.
UNREAD = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title", "textarea", "select", "option",
          "button", "audio", "video", "map", "datalist"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
           "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
           "math", "mrow", "mi", "mo", "mn", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover",
           "mfenced", "mstyle", "semantics", "annotation"}
#: Elements and name parts that speak against, or for, a block.
AGAINST = {"nav", "header", "footer", "aside", "form", "fieldset", "menu", "dialog"}
AGAINST_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comentario", "comentarios", "comment", "commentaire",
                 "commentaires", "comments", "commenti", "cookie", "cookies",
                 "consent", "copyright", "disclaimer", "disqus", "feedback", "footer", "form", "header", "kommentar", "kommentare", "legal", "login", "menu", "modal", "nav", "navbar", "navigation",
                 "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "reply", "replies", "responses", "search", "share",
                 "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget"}
#: Names that do not speak against an element that another of its classes calls content.
WEAK_NAMES = {"share", "sharing", "related", "tags", "social"}
#: Elements that close by themselves when the next of their kind opens, and those that keep an outer one open.
_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "h1", "h2", "h3", "h4", "h5", "h6"}
_HOLDING = {"ul", "ol", "table", "div", "section", "article", "dl"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FOR = {"article", "main"}
FOR_NAMES = {"article", "body", "content", "entry", "main", "post", "story", "text"}


@dataclass
class Block:
    text: str
    chars: int
    linked: int
    path: int  # number of the innermost element that holds blocks; it tells all around it
    against: int
    favour: int
    heading: bool
    paragraph: bool


@dataclass(slots=True)
class Open:
    """An open element with what it and all around it add up to."""
    name: str = ""
    against: int = 0
    favour: int = 0
    unread: int = 0
    links: int = 0
    path: int = 0
    heading: bool = False
    paragraph: bool = False
    holder: int = -1  # depth of the last element that keeps outer ones open


def names_of(tag: str) -> list[set[str]]:
    """The words of each class, id, role and label, one set per name."""
    return [set(_WORDS.findall(name)) for m in _NAMES.finditer(tag) for name in (m[1] or m[2] or m[3] or "").lower().split()]


def evidence(name: str, token: str) -> tuple[int, int]:
    """What an element's own tag says (against, for) its text being content."""
    classes = names_of(token) if "=" in token and name not in ("html", "body") else []
    bad = set().union(*classes) & AGAINST_NAMES
    good = any(c & FOR_NAMES and not c & AGAINST_NAMES for c in classes)
    if good and bad <= WEAK_NAMES:
        bad = set()
    return (name in AGAINST) + bool(bad), (name in FOR) + bool(good and not bad)


def blocks_of(html: str) -> list[Block]:
    """Blocks of text in page order with what encloses them; unclosed and stray tags are tolerated. Time grows with the page, whatever its depth."""
    out: list[Block] = []
    stack = [Open()]
    depths: dict[str, list[int]] = {}  # of the open elements of a name
    parts: list[tuple[str, bool]] = []
    number = 0
    raw: str | None = None

    def flush() -> None:
        nonlocal parts
        if parts:
            text = _SPACE.sub(" ", "".join(p for p, _ in parts)).strip(" \t\n\r\f\v")
            text = _SPACE.sub(" ", unescape(text)).strip()
            if text:
                linked = sum(len(_SPACE.sub("", p)) for p, a in parts if a)
                top = stack[-1]
                out.append(Block(text, max(1, len(text)), min(linked, len(text)), top.path, top.against, top.favour, top.heading, top.paragraph))
            parts = []

    def close(name: str) -> None:
        if depths.get(name):
            for i in range(len(stack) - 1, depths[name][-1] - 1, -1):
                depths[stack.pop().name].pop()

    for m in _TOKEN.finditer(html):
        token = m[0]
        if token[0] != "<" or len(token) == 1:
            if raw is None and not stack[-1].unread:
                parts.append((token, stack[-1].links > 0))
            continue
        tag = _TAG.match(token)
        if not tag:
            continue
        name, closing = tag[1].lower(), token[1] == "/"
        if raw is not None:
            if closing and name == raw:
                raw = None
                close(name)
            continue
        if name not in _INLINE:
            flush()
        if closing:
            close(name)
            continue
        if name in _VOID or token.endswith("/>") and name not in _RAW:
            continue
        if name in _CLOSING and depths.get(name) and stack[-1].holder < depths[name][-1]:
            close(name)
        if name not in _INLINE and stack[-1].name == "p":
            close("p")
        if name == "body":
            close("head")
        number += 1
        against, favour = evidence(name, token)
        top, block = stack[-1], name not in _INLINE
        depths.setdefault(name, []).append(len(stack))
        stack.append(Open(name, top.against + against, top.favour + favour, top.unread + (name in UNREAD), top.links + (name == "a"),
                          number if block and name not in _HEADINGS and name not in ("p", "li") else top.path, top.heading or name in _HEADINGS,
                          top.paragraph or name in ("p", "blockquote", "pre"), len(stack) if name in _HOLDING else top.holder))
        if name in _RAW:
            raw = name
    flush()
    return out


#: Log-odds of any block before its features are seen.
PRIOR = -0.6


def content_odds(b: Block) -> float:
    """Log-odds of the block being content, by its own features."""
    link = b.linked / b.chars
    enclosed = min(b.against, 2)
    z = PRIOR + 2.2 * min(b.favour, 2) - 6.0 * enclosed
    z += 0.9 * math.log1p(b.chars / 40) - 3.5 * link
    z += 0.8 * b.paragraph + 0.6 * b.heading
    z += 0.3 * min(3, sum(b.text.count(c) for c in ".!?,;"))
    return z


def cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost, True for content: shortest augmenting paths, level by level, then what the source reaches."""
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, forth: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        room.append(forth)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, z in enumerate(odds):
        if z >= 0:
            tie(source, i, z, 0.0)
        else:
            tie(i, sink, -z, 0.0)
    for a, b, w in edges:
        tie(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in at[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        while True:
            path: list[int] = []
            u = source
            while u != sink:
                while turn[u] < len(at[u]):
                    e = at[u][turn[u]]
                    if room[e] > tiny and level[to[e]] == level[u] + 1:
                        break
                    turn[u] += 1
                if turn[u] == len(at[u]):
                    if not path:
                        break
                    back = path.pop()
                    u = to[back ^ 1]
                    turn[u] += 1
                    continue
                path.append(at[u][turn[u]])
                u = to[path[-1]]
            if u != sink:
                break
            flow = min(room[e] for e in path)
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow


def smoothness(found: list[Block], near: float = 0.8, same: float = 0.8) -> list[tuple[int, int, float]]:
    """Ties of page neighbours, stronger within one element, and of each block with the previous one of its element."""
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            shared = b.path == found[i - 1].path
            edges.append((i - 1, i, near if shared else 0.25 * near))
        j = last.get(b.path)
        if j is not None and j != i - 1:
            edges.append((j, i, same))
        last[b.path] = i
    return edges


def main_text(html: str | None) -> str:
    """Content blocks in page order, joined by one blank; empty if there are none.

    On a page that would lose all its text, blocks count by their features alone.
    """
    found = blocks_of(text_of(html))
    if not found:
        return ""
    odds = [content_odds(b) for b in found]
    keep = cut(odds, smoothness(found))
    if not any(keep):
        keep = cut([z - PRIOR for z in odds], smoothness(found))
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, *, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in a column that clashes with no other.

    Row by row on the whole html, of any length and depth. Null and empty html, and pages without content,
    give empty text; repeated rows give equal texts.
    """
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([main_text(h) for h in series], dtype="object")

    return pages.withColumn(free_name(pages, out), text(F.col(html)))
