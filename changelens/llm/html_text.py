"""Main text of web pages as the maximum-scoring run of words and tags.

A page is read once into a row of tokens: words, filed by the block that holds
them, and tags, filed by name and class. On labelled pages (those that mark their
content themselves, by exactly one article or main element) the tokens inside and
outside the content give each kind a weight, the log of how much likelier it is
inside: words of content score positive, tags and words of furniture negative.
The labelling tags themselves are no tokens. On every page a linear scan then
finds the contiguous run with the largest sum. Elements that are no article text
wherever they stand (menus, forms, scripts, adverts, reader comments, ...) are
taken out before the scan and leave a small negative score behind.

Text inside a block has its character references decoded and its white space
turned into single spaces; blocks are joined by one space, in page order.

Cases: null or empty html gives an empty text, as does a page without words in
its best run. Tags left open end with their parents; markup broken off at the end
of the page counts as a tag. Pages of any length are read whole. Rows are
independent: repeated rows give repeated results; ties between runs go to the
first. With no labelled page the weights are the prior ones (words 1, of links LINKED,
tags UNSEEN). Classes and ids take an element out only if they name furniture alone.
An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Weights are learned from this many labelled pages at most, none longer than PAGE_BYTES.
FIT_PAGES, PAGE_BYTES = 1000, 1 << 18

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(/?)(?:>|(?=<)|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_RAW = frozenset("script style template noscript textarea title iframe xmp noembed noframes svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr ruby rt rp nobr".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
_SAME = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Never part of an article's text.
_OUT = frozenset("head nav aside form button select dialog menu object audio video canvas map datalist footer input".split()) | _RAW
#: Words of classes and ids that name furniture, and words that say nothing beside them. A class
#: counts only if nothing else is in it: "share-buttons" does, "share-price" does not.
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent "
    "gdpr notice popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets related recommended "
    "recommendations share sharing social comment comments disqus respond replies footer masthead newsletter subscribe subscription "
    "signup login search pagination pager hidden header".split()
)
_PLAIN = frozenset(
    "box bar list links link button buttons btn container wrapper wrap block area section top bottom left right inner outer site page "
    "global primary secondary main mobile desktop form item items icon icons post posts article articles blog entry content unit slot "
    "group panel dismissible widget text title level".split()
)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: A block outside the labelled content that states who holds the rights, in a few words.
_RIGHTS = re.compile(r"\s*(?:(?:©|\(c\))\s*\S|copyright\s*(?:©|\(c\)|\d{4})|all rights reserved)", re.I)
RIGHTS_WORDS = 25
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_MARKS = frozenset(["article", "main"])
OUT_PENALTY = 0.5
#: Weights of tags and of words of links that no labelled page had; occurrences that outweigh them.
UNSEEN, LINKED, SMOOTH = -0.1, 0.3, 20


def is_furniture(value: str) -> bool:
    """Whether a class or id attribute names furniture of the page and nothing else."""
    for token in value.split():
        parts = [p.lower() for p in _PARTS.findall(token)]
        if any(p in _FURNITURE for p in parts) and all(p in _FURNITURE or p in _PLAIN or p.isdigit() for p in parts):
            return True
    return False


class Page:
    """Tokens of a page: kinds[i] weighs counts[i] times; texts[i] is the text a
    token brings, or None; marks are the (from, to) token ranges of labelling elements."""

    __slots__ = ("kinds", "counts", "texts", "marks", "marked")

    def __init__(self, source: str):
        self.kinds: list[str] = []
        self.counts: list[int] = []
        self.texts: list[str | None] = []
        self.marks: list[tuple[int, int]] = []
        self.marked = 0  # open labelling elements
        self.read(source)

    def add(self, kind: str, count: int, text: str | None) -> None:
        self.kinds.append(kind)
        self.counts.append(count)
        self.texts.append(text)

    def words(self, raw: str, block: str, linked: bool) -> None:
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        n = len(text.split())
        if n and n <= RIGHTS_WORDS and not self.marked and _RIGHTS.match(text):
            self.add("rights", n, text)
        else:
            self.add(f"w:{block}{':a' if linked else ''}", n, text)

    def read(self, source: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # name, token where a mark began or -1, taken out
        opened: Counter = Counter()  # names on the stack
        out = 0  # open elements that are taken out
        pos, end = 0, len(source)
        find = _TAG.search

        def close(to: int) -> None:
            nonlocal out
            while len(stack) > to:
                name, at, is_out = stack.pop()
                opened[name] -= 1
                self.marked -= name in _MARKS
                out -= is_out
                if at >= 0:
                    self.marks.append((at, len(self.kinds)))

        def place() -> tuple[str, bool]:
            block, linked = "body", False
            for name, _, _ in reversed(stack):
                if name == "a":
                    linked = True
                elif name not in _INLINE:
                    block = name
                    break
            return ("body" if block in _MARKS or block == "html" else block), linked

        while pos < end:
            m = find(source, pos)
            if m is None:
                if not out:
                    # a tag that the page's end cuts off
                    cut = re.search(r"<[A-Za-z/!?][^<]*\Z", source[pos:])
                    self.words(source[pos : pos + cut.start()] if cut else source[pos:], *place())
                break
            if m.start() > pos and not out:
                self.words(source[pos : m.start()], *place())
            pos = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                was_out = out
                for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                    if stack[k][0] == name:
                        close(k)
                        break
                if not was_out and name not in _MARKS:
                    self.add(f"t:/{name}", 1, None if name in _INLINE else " ")
                continue
            if name in _ENDS_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] not in _INLINE:
                        break
            if name in _SAME:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in _SAME[name]:
                        close(k)
                        if name != "tr":
                            break
                    elif stack[k][0] in _HOLDS[name]:
                        break
            is_out, cls = name in _OUT, ""
            if m[3] and not is_out:
                for attr, value in _ATTR.findall(m[3]):
                    attr, value = attr.lower(), value.strip("\"'")
                    if attr in ("class", "id"):
                        cls = cls or value
                        is_out |= name not in ("html", "body", "article", "main", "h1") and is_furniture(value)
                    elif attr == "role":
                        is_out |= value.lower() in _OUT_ROLES
                    elif attr == "hidden" or attr == "aria-hidden" and value.lower() == "true":
                        is_out |= name not in ("html", "body")
                    elif attr == "style":
                        is_out |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            if name == "header" and not self.marked:
                is_out = True
            if not out:
                if is_out:
                    self.add("out", 1, None if name in _INLINE else " ")
                elif name not in _MARKS:
                    self.add(f"t:{name}" + (f".{cls.split()[0]}" if cls.split() else ""), 1, None if name in _INLINE else " ")
                else:
                    self.add("mark", 0, " ")
            if name in _VOID or m[4] == "/" and name not in _RAW:
                continue
            if name in _RAW:
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, pos)
                pos = stop.end() if stop else end
                continue
            stack.append((name, len(self.kinds) if name in _MARKS and not out else -1, is_out))
            opened[name] += 1
            self.marked += name in _MARKS
            out += is_out
        close(0)


def label(page: Page) -> tuple[int, int] | None:
    """The content's token range, where the page marks it without doubt."""
    outer = [m for m in page.marks if not any(o != m and o[0] <= m[0] and m[1] <= o[1] for o in page.marks)]
    return outer[0] if len(outer) == 1 and outer[0][0] < outer[0][1] else None


def learn(pages: list[str]) -> dict[str, float]:
    """Weights of token kinds, from labelled pages. SMOOTH occurrences at even odds are added
    to each kind, so what is rare stays near the weight of what was never seen: LINKED for
    words of links, 1 for other words ('') and UNSEEN for tags ('t')."""
    inside, outside = Counter(), Counter()
    for source in pages:
        page = Page(source)
        span = label(page)
        if span is None:
            continue
        for k, (kind, n) in enumerate(zip(page.kinds, page.counts)):
            if kind[:2] in ("w:", "t:") and n:
                (inside if span[0] <= k < span[1] else outside)[kind] += n
    weights = {"": 1.0, ":a": LINKED, "t": UNSEEN, "mark": 0.0, "out": -OUT_PENALTY, "rights": -1.0}
    for word in ("w", "t"):
        kinds = [k for k in inside.keys() | outside.keys() if k[0] == word]
        n_in, n_out = sum(inside[k] for k in kinds) + 1, sum(outside[k] for k in kinds) + 1
        for k in kinds:
            share = (inside[k] + outside[k]) / (inside[k] + outside[k] + SMOOTH)
            ratio = math.log((inside[k] / n_in + 1e-4) / (outside[k] / n_out + 1e-4))
            # a word of content is worth 1 at most, a tag costs something even there
            own = max(-3.0, min(1.0, ratio)) if word == "w" else max(-3.0, min(-0.05, ratio - 1.0))
            unseen = UNSEEN if word == "t" else LINKED if k.endswith(":a") else 1.0
            weights[k] = share * own + (1 - share) * unseen
    return weights


def weight(kind: str, weights: dict[str, float]) -> float:
    own = weights.get(kind)
    if own is None:
        own = weights["t"] if kind[0] == "t" else weights[":a"] if kind.endswith(":a") else weights[""]
    return own


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest positive sum, the first of equals; linear."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, at = total, (start, k + 1)
    return at


def main_text(source: str | None, weights: dict[str, float]) -> str:
    if not source:
        return ""
    page = Page(source)
    scores = [weight(k, weights) * n for k, n in zip(page.kinds, page.counts)]
    lo, hi = best_run(scores)
    return " ".join("".join([t for t in page.texts[lo:hi] if t is not None]).split())


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> dict[str, float]:
    """Weights from a bounded sample of the pages that label themselves: those whose id has
    the smallest hashes. They are counted first, and a threshold on the hash lets about twice
    as many through as are wanted, so no task sorts more than that."""
    own = pages.where(F.col(html_col).rlike("(?i)<(article|main)[\\s>]") & (F.octet_length(html_col) <= PAGE_BYTES))
    place = F.xxhash64(id_col)
    n = own.count()
    if n > 2 * FIT_PAGES:
        own = own.where(place < F.lit(-(2**63) + int(2**64 * (2 * FIT_PAGES / n))))
    pick = own.select(html_col, place.alias("place")).orderBy("place", html_col).limit(FIT_PAGES)
    return learn([r[0] for r in pick.select(html_col).toLocalIterator()])


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html)."""
    w = fit(pages) if weights is None else weights
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def row(r):
        text = main_text(r[2], w)
        return r[0], r[1], text, len(text)

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_rows(src, lambda: row, out, "page_id long, url string, text string, n_chars long")
