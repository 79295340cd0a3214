"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block. Text lengths, without those of links, are summed over sliding windows of WINDOW lines of the whole page. The text surges at the first
window over the threshold and dives where a window sums to zero. A line counts nothing that is mostly link or, outside an article, a copyright notice or a short label
(under LABEL characters, no sentence, no heading or table cell). Between surge and dive, whole, is text; lines before the surge are not, outside an article, except the headings next to it.

Tags only add gaps of WINDOW blank lines: the edge of an article or <main>, and what is menu, header, footer, sidebar, notice, advert, form, script, style or comment by its element
or a whole token of its class, id, role or label. That is left out, unless it holds an h1, the largest article or most of the unlinked text, and inside an article leaves no gap. If texts inside articles hold at least half of all that surges, those outside are dropped.

Defined results: a null or empty html gives an empty text; a page where nothing surges keeps the longest run between gaps, of an article if there is one; repeated rows get equal results; an empty table
gives an empty table; columns beside page_id, url and html do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, SURGE, LINKED, LABEL = 3, 80, 0.5, 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_RAW = frozenset(("script", "style", "template", "noscript", "iframe", "textarea", "title", "xmp", "noembed"))
_AWAY = frozenset(("head", "nav", "footer", "aside", "form", "button", "select", "svg", "menu", "dialog"))
_NEVER = frozenset(("head", "select", "svg"))
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_KINDS = dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "h") | dict.fromkeys(("td", "th", "dt", "dd", "pre"), "t")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whole tokens of class, id, role or aria-label. What only contains such a word ("no-sidebar", "page-builder-widget", "page-header") is no hint.
_HINT = re.compile(
    r"(?:(?:site|main|global|top|bottom|primary|secondary|left|right|mobile|sticky|fixed|page(?=[_-]footer))[_-])?"
    r"(?:ads?|advert|advertisements?|advertising|advertorial|banner|breadcrumbs?|comments?|consent|contentinfo|cookies?|disqus|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|overlay|pagination|popup"
    r"|promo|promos|promoted|promotions?|related|replies|respond|share|sharing|side-?bar|social|sponsor|sponsored|sponsors|subscribe|subscription|toolbar|widget)"
    r"(?:[_-](?:ads?|area|banner|bar|block|body|box|buttons?|consent|container|form|icons?|inner|items?|links?|list|media|menu|message|nav|notice|overlay|panel|popup|posts?|section|slot|thread|unit|widget|wrap|wrapper))*",
    re.I,
)
_TALK = re.compile(r"comment|disqus|replies|respond", re.I)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)

_SENTENCE = re.compile(r"[.!?:;\u2026\u3002\uff01\uff1f\u061f\u0964][\"'\u2019\u201d\u00bb)\]]*$")
_RIGHTS = re.compile(r"\u00a9|^\(c\) |^copyright\b|\ball rights reserved\b", re.I)


def _away(name: str, attrs: str, in_article: int) -> bool:
    """Whether an element is outside the main text by its name or class."""
    if name in _AWAY or (name == "header" and not in_article):
        return True
    if not attrs or name in ("html", "body", "main", "h1") or (name == "article" and "comment" not in attrs):
        return False
    return bool(_HIDDEN.search(attrs)) or any(_HINT.fullmatch(x) for m in _NAMED.findall(attrs) for x in next(filter(None, m), "").split())


def _tokens(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag; comments and raw text have an empty name."""
    at = 0
    while m := _TOKEN.search(html, at):
        at, name = m.end(), (m[2] or "").lower()
        if name in _RAW and not m[1]:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else (len(html) if name in ("script", "style") else at)
            name = ""
        yield m.start(), at, m[1] or "", name, m[3] or ""


def _holder(html: str, tokens: list, closes: dict[int, int]):
    """Whether the element that a token opens holds too much to be left out: a written h1, the page's largest article, or most of its unlinked text.

    Comments may be the most beside an article of some length.
    """
    upto, in_link, at = [0], False, 0
    for start, end, slash, name, _ in tokens:
        upto.append(upto[-1] + (0 if in_link else len(html[at:start].strip())))
        at = end
        if name == "a":
            in_link = not slash
    total = upto[-1] + len(html[at:].strip())
    size = lambda k: upto[closes[k] + 1] - upto[k + 1]
    whole = [k for k, (_, _, slash, name, attrs) in enumerate(tokens) if not slash and k in closes and name in ("article", "main", "h1") and size(k) and not _away(name, attrs, 1)]
    articles = [k for k in whole if tokens[k][3] != "h1"]
    largest = max(articles, key=size, default=-1)

    def held(k: int) -> bool:
        if tokens[k][3] in _NEVER:
            return False
        if any(k < i < closes[k] for i in whole if tokens[i][3] == "h1" or i == largest):
            return True
        if 2 * size(k) <= total:
            return False
        rest = size(largest) - size(k) * (largest < k < closes[largest]) if articles else 0
        return rest < 5 * SURGE or not _TALK.search(tokens[k][4])

    return held


class Line(NamedTuple):
    text: str
    linked: int  # characters in links
    inside: bool  # an article
    kind: str  # "h" of a heading, "t" of a table or other preformatted cell


GAP = Line("", 0, False, "")


def lines_of(html: str) -> list[Line]:
    """Each block in page order, and gaps."""
    tokens = list(_tokens(html))
    opened: dict[str, list[int]] = {}
    closes: dict[int, int] = {}
    for k, (_, _, slash, name, _) in enumerate(tokens):
        if not name or name in _VOID:
            continue
        if not slash:
            opened.setdefault(name, []).append(k)
        elif opened.get(name):
            closes[opened[name].pop()] = k
    held = _holder(html, tokens, closes)
    out: list[Line] = []
    parts: list[str] = []
    links, in_link, articles, at, k, kind = 0, False, 0, 0, 0, ""

    def flush():
        nonlocal links
        raw = "".join(parts)
        if text := " ".join((unescape(raw) if "&" in raw else raw).split()):
            out.append(Line(text, min(links, len(text)), articles > 0, kind))
        parts.clear()
        links = 0

    def add(text: str):
        nonlocal links
        if text:
            parts.append(text)
            links += len(text) * in_link

    while k < len(tokens):
        start, end, slash, name, attrs = tokens[k]
        add(html[at:start])
        at = end
        if name and not slash and k in closes and _away(name, attrs, articles) and not held(k):
            flush()
            if not articles:
                out.append(GAP)
            k = closes[k]
            at = tokens[k][1]
        elif name in _BLOCK:
            flush()
            kind = "" if slash else _KINDS.get(name, "")
            if name in ("article", "main"):
                before, articles = articles, max(0, articles + (-1 if slash else k in closes))
                if not before or not articles:
                    out.append(GAP)
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = not slash
        k += 1
    add(html[at:])
    flush()
    return out


def _value(line: Line) -> int:
    """What a line adds to its windows."""
    size = len(line.text)
    if size - line.linked < LINKED * size:
        return 0
    if not line.inside and ((size < 4 * SURGE and _RIGHTS.search(line.text)) or (size < LABEL and not line.kind and not _SENTENCE.search(line.text))):
        return 0
    return size - line.linked


def _texts(run: list[Line]) -> Iterator[list[Line]]:
    """What surges in the lines between two gaps. Blank lines follow the run, so windows at its end are sums over what is left of it."""
    values = [_value(line) for line in run]
    sums = [sum(values[i : i + WINDOW]) for i in range(len(run))]
    start, least = 0, 0
    while start < len(run):
        if not values[start] or sums[start] < SURGE:
            ahead = next((i for i in range(start, len(run)) if sums[i] >= SURGE), None)
            if ahead is None:
                return
            start = next(i for i in range(ahead, len(run)) if values[i])
        end = next((i for i in range(start, len(run)) if not sums[i]), len(run))  # the dive
        while not values[end - 1]:
            end -= 1
        while end > start + 1 and run[end - 1].kind == "h" and not run[end - 1].inside:
            end -= 1
        first = start
        if run[start].inside:  # up to the last window of zero, or the edge of the article
            while any(values[max(least, first - WINDOW) : first]):
                first -= 1
            while not values[first] and run[first].kind != "h":
                first += 1
        while (title := next((i for i in range(first - 1, max(least, first - WINDOW) - 1, -1) if run[i].kind == "h"), None)) is not None:
            first = title
        yield run[first:end]
        start = least = end


def main_text(html: str) -> str:
    runs: list[list[Line]] = [[]]
    for line in lines_of(html):
        runs[-1].append(line) if line.text else runs.append([])
    runs = [r for r in runs if r]
    bare = lambda lines: sum(len(x.text) - x.linked for x in lines)
    kept = [t for r in runs for t in _texts(r)]
    inside = [t for t in kept if t[0].inside]
    if 2 * sum(map(bare, inside)) >= sum(map(bare, kept)):
        kept = inside
    if not kept:
        kept = sorted([r for r in runs if r[0].inside] or runs, key=bare, reverse=True)[:1]
    return "\n".join(x.text for t in kept for x in t)


@F.pandas_udf(T.StringType())
def _main_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in parts:
        yield pages.map(main_text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", _main_text(F.coalesce("html", F.lit(""))).alias("text"))
    return rows.select("*", F.char_length("text").cast("long").alias("n_chars"))
