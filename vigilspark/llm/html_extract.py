"""Main-text extraction by line-block distribution.

The markup is stripped into blocks, one line each, in page order. A line weighs as many characters as its text outside
links and separators has; lines of page furniture (menus, headers, footers, side bars, notices, adverts, forms, reader comments), told
by their elements and by class, id or role, weigh nothing. An element that is furniture by its class or id, or a form, is
a mere wrapper where it holds main (or role=main) or more than half of the page's text; names after has-, no- and with-
don't count, and readers' comments are no wrapper unless one article has that half. The distribution is the sum of weights over a sliding window
of `LINES` lines. A surge point is where the window first carries more than the threshold, a dive point where it falls
to nothing; the text between the surge and the dive is kept, without furniture.

A surge needs more than `SURGE` characters, and every region is kept in page order, with its short first lines (a heading
before the surge belongs to it). Where the page marks its article (article, main, or role=main), the marks only widen a
region to their ends, so that short lines there stay; of the lines before the first surge inside them, runs of at least
`LINES` lines of links alone (a menu) are left out, while links that follow text (references) stay. Text outside the marks
is a region of its own from `OUTSIDE` characters on. Inside the marks, a class or id makes an element furniture only if
one whole token of it says so (`comments`, `share-buttons`, not `notice-period` or `related-work`), and never a heading, a
paragraph, a quote, a cell or an item; a section only by its class or as readers' comments.

Defined cases: a null or empty page gives the empty string; unclosed elements end with their parents, an unfinished tag
at the end is dropped; character references are decoded; white space inside a block becomes one space; line breaks are
white space; repeated rows give equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm import common

LINES = 3
SURGE = 80
#: Characters from which text outside a marked article is a region of its own.
OUTSIDE = 400

# Fixed values of HTML: elements without content, with raw content, that break lines, and that are furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas annotation annotation-xml select noframes".split())
BREAKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul head".split())
FURNITURE = frozenset("nav header footer aside form button menu dialog label fieldset search head input".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement advertising adsbygoogle banner sponsor sponsored promo promotion sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottombar "
    "comment comments commentlist respond disqus replies reply cookie cookies consent gdpr notice notices alert popup modal overlay toast newsletter subscribe subscription signup login share sharing social related recommended "
    "widget pagination pager search form disclaimer copyright toc skip".split()
)
# Nouns that tell nothing of an element's content beside a furniture name, and elements that hold an article's own text.
GENERIC = frozenset("area bar block blocks box button buttons container content group holder inner item items link links list outer panel placeholder post posts row section slot stories unit wrap wrapper".split())
CONTENT = frozenset("h1 h2 h3 h4 h5 h6 p blockquote q pre li dt dd td th tr caption figure figcaption table thead tbody tfoot summary details code".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Za-z]+")
_TOKENS = re.compile(r"\S+")
_WORDS = re.compile(r"[a-z]+")
#: A word after one of these tells of a layout, not of the element itself: has-sidebar, no-sidebar, page-with-comments.
LAYOUT = frozenset("has no with without".split())
COMMENTS = frozenset("comment comments commentlist respond disqus replies reply".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Line(NamedTuple):
    text: str
    weight: int  # characters outside links and separators
    furniture: bool
    article: bool  # in the marked article
    links: bool  # holds links, and nothing that weighs


class Wrap:
    """An element that is furniture by its names, or a form: it is a mere layout wrapper if it holds the page's main text."""

    __slots__ = ("comments", "weight", "main", "article")

    def __init__(self, comments: bool) -> None:
        self.comments, self.weight, self.main, self.article = comments, 0, False, 0

    def lifted(self, total: int) -> bool:
        return self.main or self.weight * 2 > total and (not self.comments or self.article * 2 > total)


def _names(value: str) -> set[str]:
    """The furniture names in a class or id, without those of layouts (has-sidebar)."""
    found = set()
    for token in _TOKENS.findall(value):
        words = _WORDS.findall(token)
        if LAYOUT.isdisjoint(words):
            found.update(words)
        else:
            found.update(words[: next(k for k, w in enumerate(words) if w in LAYOUT)])
    return found & FURNITURE_NAMES


def _whole_names(value: str) -> set[str]:
    """The furniture names of those tokens of a class or id that are made of such names and generic nouns alone."""
    found = set()
    for token in _TOKENS.findall(value):
        words = set(_WORDS.findall(token))
        names = words & FURNITURE_NAMES
        if names and words <= FURNITURE_NAMES | GENERIC:
            found |= names
    return found


def _furniture(tag: str, attrs: str, inside: bool) -> tuple[bool, Wrap | None]:
    """Whether an element is page furniture for good, and else the wrapper that its names or its being a form make of it.

    inside: within the marked article, where a header is the article's own.
    """
    if tag in FURNITURE and tag != "form" and not (inside and tag in ("header", "label", "fieldset")):
        return True, None
    wrap = Wrap(False) if tag == "form" else None
    if not attrs or tag in ("body", "html", "article", "main"):
        return False, wrap
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True, None
        if name == "role" and value in FURNITURE_ROLES:
            return True, None
        if name in ("class", "id"):
            names = _whole_names(value) if inside else _names(value)
            if inside and (tag in CONTENT or tag == "section" and name == "id" and names.isdisjoint(COMMENTS)):
                continue
            if names and not (inside and names <= {"header"}):
                wrap = Wrap(not names.isdisjoint(COMMENTS) or wrap is not None and wrap.comments)
    return False, wrap


def blocks(html: str) -> tuple[list[Line], bool]:
    """The page's lines, and whether it marks an article."""
    lines: list[tuple[str, int, bool, int, tuple[Wrap, ...], bool]] = []
    stack: list[tuple[str, bool, int, bool, tuple[Wrap, ...]]] = []  # tag, furniture, article (its number from 1), link, wrappers
    articles: list[tuple[bool, tuple[Wrap, ...], bool]] = []  # furniture, wrappers, of a reader's comment
    wraps: tuple[Wrap, ...] = ()
    parts: list[str] = []
    linked = 0
    links = False
    furniture = link = False
    article = 0

    def flush() -> None:
        nonlocal linked, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                weight = max(0, len(text) - linked)
                lines.append((text, weight, furniture, article, wraps, links and not weight))
            parts.clear()
        linked = 0
        links = False

    def settle() -> None:
        nonlocal furniture, article, link, wraps
        _, furniture, article, link, wraps = stack[-1] if stack else ("", False, 0, False, ())

    pos, end = 0, len(html)
    while pos < end:
        m = _TOKEN.search(html, pos)
        text = html[pos : m.start() if m else end]
        if text:
            text = unescape(text)
            parts.append(text)
            if link or not any(c.isalnum() for c in text):
                linked += len(text)
                links = links or link and any(c.isalnum() for c in text)
        if not m:
            break
        pos = m.end()
        if not m[2]:
            continue
        if not m[4] and m.end() == end:
            break
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "annotation", "annotation-xml"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, pos)
                pos = stop.end() if stop else end
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BREAKS:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    settle()
                    break
            continue
        if tag in VOID:
            continue
        if tag in BREAKS:
            while stack and stack[-1][0] == "p":
                stack.pop()
            if tag in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES[tag]:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "div", "select"):
                        break
            settle()
        starts = tag in ("article", "main") or "main" in m[3] and bool(re.search(r"\brole\s*=\s*[\"']?main\b", m[3]))
        fixed, wrap = _furniture(tag, m[3], bool(article or starts))
        if starts and not (article and tag == "article"):
            comment = any(name[1].lower() in ("class", "id") and not _names((name[2] or name[3] or name[4] or "").lower()).isdisjoint(COMMENTS) for name in _ATTR.finditer(m[3]))
            articles.append((furniture, wraps, comment))
            if tag != "article" and not furniture:
                for w in wraps:
                    w.main = True
        number = len(articles) if starts and not (article and tag == "article") else article
        stack.append((tag, furniture or fixed, number, link or tag == "a", (*wraps, wrap) if wrap else wraps))
        settle()
    flush()
    return _judged(lines, articles)


def _judged(lines: list[tuple[str, int, bool, int, tuple[Wrap, ...], bool]], articles: list[tuple[bool, tuple[Wrap, ...], bool]]) -> tuple[list[Line], bool]:
    """The lines with wrappers judged by what they hold, and whether an article is marked outside furniture."""
    if any(x[4] for x in lines):
        total, own = 0, [0] * (len(articles) + 1)
        for _, weight, furniture, article, wraps, _ in lines:
            if not furniture:
                total += weight
                own[article] += weight
                for w in wraps:
                    w.weight += weight
        for (_, wraps, comment), weight in zip(articles, own[1:], strict=True):
            for w in wraps if not comment else ():
                w.article = max(w.article, weight)
        kept = {w: w.lifted(total) for x in lines for w in x[4]}
    else:
        kept = {}
    marked = any(not furniture and all(kept.get(w, False) for w in wraps) for furniture, wraps, _ in articles)
    return [Line(text, weight, furniture or not all(kept[w] for w in wraps), article > 0, links) for text, weight, furniture, article, wraps, links in lines], marked


def main_lines(lines: list[Line], marked: bool, width: int = LINES, surge: int = SURGE) -> list[str]:
    """The lines between the surge and the dive of the distribution."""
    weights = [0 if x.furniture else x.weight for x in lines]
    sums = [sum(weights[i : i + width]) for i in range(len(weights))]
    threshold = surge if max(sums, default=0) > surge else 0
    regions, i = [], 0
    while i < len(sums):
        if sums[i] <= threshold:
            i += 1
            continue
        dive = i
        while dive < len(sums) and sums[dive] > 0:
            dive += 1
        while i > 0 and weights[i - 1] > 0:
            i -= 1
        regions.append((i, dive))
        i = dive
    if not marked:
        return [x.text for start, stop in regions for x in lines[start:stop] if not x.furniture]
    return _widened(lines, weights, regions, width)


def _widened(lines: list[Line], weights: list[int], regions: list[tuple[int, int]], width: int) -> list[str]:
    """Regions widened to the ends of the marked article, and those outside that hold enough."""
    own = [k for k, x in enumerate(lines) if x.article and not x.furniture]
    kept = set(own)
    # before the first line of the article that weighs, runs of links are a menu
    head = own[: next((n for n, k in enumerate(own) if weights[k]), 0)]
    run: list[int] = []
    for k in [*head, None]:
        if k is not None and lines[k].links:
            run.append(k)
            continue
        if len(run) >= width:
            kept.difference_update(run)
        run = []
    for start, stop in regions:
        # the parts of a region before, between and after marked lines
        part: list[int] = []
        for k in [*range(start, stop), None]:
            if k is not None and not lines[k].article:
                part.append(k)
                continue
            if sum(weights[j] for j in part) >= OUTSIDE:
                kept.update(j for j in part if not lines[j].furniture)
            part = []
    return [lines[k].text for k in sorted(kept)]


def main_text(html: str | None) -> str:
    return "\n".join(main_lines(*blocks(html))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(h) for h in part.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return common.pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id bigint, url string, text string")
