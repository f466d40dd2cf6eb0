"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags. A block is described by its number of words and link density, by
those of the blocks before and after it, by the words beside it in its section, and by what its containers say. A
decision tree, grown on the small labelled table below, says which blocks are the article.
"""

from __future__ import annotations

import html
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

TAG = re.compile(
    r"""<!--.*?(?:-->|--!>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([a-zA-Z_:][-\w:.]*)""")
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "label"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = {"article", "main"}
#: Containers that never hold the article; within a main one a header belongs to it.
OUTSIDE = {"nav", "footer", "aside", "form", "head", "noscript", "button", "select", "option", "template", "svg", "dialog", "menu", "object", "audio", "video", "canvas", "datalist", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Words of a class or id that mark what isn't the article.
MARKS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored banner promo promoted promotion cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside side menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar login signup signin register subscribe subscription newsletter share sharing social related recommended recommendations widget pagination pager search hidden disclaimer copyright".split())
REPLIES = {"comment", "comments", "commentlist", "reply", "replies", "respond", "discussion", "disqus", "reactions"}
WORDS = re.compile(r"[a-z]+")

#: Words beside a mark in a class or id that leave it one: "ad-slot" is an advert, "hidden-costs" and "related-work" are topics.
PLAIN = set("box container wrapper wrap block list area section bar inner outer item items link links text slot unit zone space panel site page global primary secondary main left right top bottom content post posts entry article buttons button icons js col column row group header footer form message".split())
#: Elements within a section; any other container is a section of its own.
FLOW = INLINE | HEADINGS | {"p", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "figure", "figcaption", "center", "hgroup", "address", "details", "summary"}

#: mark is 2 within a container that never holds the article, 1 within one whose class or id says so; main is 1 within a
#: main container, 0 on a page without one, -1 outside that of a page with one; section is the number of unlinked words
#: of the unmarked blocks in the block's section.
FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "mark", "main", "heading", "section")
#: Labelled blocks: the features in order (densities in percent), then 1 for article. A line is a sort of block.
LABELLED = """
5 100 0 0 6 100 2 0 0 0 0|1 100 1 100 12 0 2 -1 0 0 0|12 0 1 100 9 0 2 -1 0 0 0|120 0 3 0 80 0 2 0 0 0 0|9 0 80 0 0 0 2 -1 0 0 0|30 0 200 0 0 0 2 0 0 0 0|60 10 30 0 50 0 2 1 0 0 0|18 0 0 0 22 0 2 1 0 0 0|35 0 50 0 4 100 2 1 0 0 0|80 0 90 0 100 0 2 1 0 0 0|2 0 60 0 5 0 2 1 1 0 0|200 0 60 0 80 0 2 1 0 0 0
35 0 50 0 0 0 2 1 0 0 0|5 0 80 0 0 0 2 1 0 0 0|120 0 60 0 0 0 2 1 0 0 0|150 0 90 0 80 0 2 1 0 0 0|90 0 120 0 70 0 2 1 0 0 0|300 2 90 0 60 0 2 1 0 0 0|1 0 0 0 0 0 2 1 0 0 0|3 100 3 100 60 0 2 1 0 0 0|90 0 80 0 70 0 2 1 1 0 0|1 0 0 0 0 0 2 0 0 0 0|120 0 90 0 100 0 2 0 0 0 0|9 0 90 0 90 0 2 0 1 0 0|90 0 90 0 90 0 2 0 0 0 0|25 0 60 0 90 0 2 0 0 0 0|80 5 120 0 60 0 2 1 0 0 0|200 0 200 0 200 0 2 1 0 0 0|75 0 60 0 45 0 2 1 0 0 0|110 9 75 0 95 0 2 1 0 0 0
20 0 60 0 0 0 1 1 0 0 0|8 0 30 0 0 0 1 1 0 0 0|3 0 12 0 0 0 1 1 0 0 0|50 0 100 0 0 0 1 1 0 0 0|1 0 0 0 0 0 1 1 0 0 0|100 0 60 0 0 0 1 1 0 0 0|1 0 0 0 0 0 1 0 0 0 0|30 0 60 0 60 0 1 0 0 0 0|60 0 120 0 120 0 1 0 0 0 0|200 0 0 0 0 0 1 0 0 0 0|200 0 100 0 100 0 1 0 0 0 0|90 0 90 0 0 0 1 0 0 0 0|120 5 60 0 60 0 1 0 0 0 0|100 0 80 0 70 0 1 -1 0 0 0|140 0 90 0 60 0 1 0 0 0 0|75 0 100 0 80 0 1 -1 0 0 0|110 0 120 0 9 0 1 -1 0 0 0|95 8 85 0 70 0 1 0 0 0 0|90 10 0 0 0 0 1 0 0 0 0|200 5 60 0 60 0 1 -1 0 0 0|120 10 120 0 90 0 1 0 0 0 0|90 10 0 0 0 0 1 1 0 0 0
90 10 0 0 0 0 2 1 0 0 0|150 5 60 0 90 0 2 0 0 0 0|200 10 100 0 100 0 2 1 0 0 0|120 4 60 0 60 0 2 1 0 0 0|90 8 120 0 90 0 2 -1 0 0 0|75 3 80 0 80 0 2 1 0 0 0|110 0 60 0 60 0 2 1 0 0 0|250 1 150 0 150 0 2 1 0 0 0|85 6 70 0 50 0 2 1 0 0 0
5 100 5 0 4 100 0 1 0 8 1|4 100 4 100 5 100 0 1 0 9 1|3 100 6 0 3 100 0 1 0 12 1|2 100 2 100 30 0 0 1 0 30 1|8 80 9 0 3 100 0 1 0 25 1|1 100 1 100 1 100 0 1 0 1 0|2 100 2 100 1 100 0 1 0 3 0
1 0 1 0 9 0 0 1 0 2 1|1 0 2 0 12 0 0 1 0 3 1|2 0 1 0 8 0 0 1 0 3 1|1 0 5 0 12 0 0 1 0 1 1|1 0 1 0 9 0 0 1 1 2 1|2 0 2 100 9 0 0 1 1 2 1|1 0 1 100 12 0 0 1 1 1 1|1 0 1 100 1 0 0 1 0 1 1
12 0 1 100 9 0 1 -1 0 0 0|25 0 2 100 60 0 1 -1 0 0 0|8 0 1 100 5 0 1 0 0 0 0|40 0 1 100 8 0 1 -1 0 0 0|150 0 60 0 90 0 1 0 0 0 0|3 0 40 0 2 0 1 0 0 0 0|6 50 90 0 70 0 1 -1 0 0 0|4 0 0 0 30 0 1 0 1 0 0|200 0 30 0 90 0 1 -1 0 0 0|90 0 70 0 80 0 1 0 0 0 0
6 0 90 0 70 0 1 1 0 0 0|18 0 60 0 45 0 1 1 0 0 0|30 20 50 0 80 0 1 1 0 0 0|45 0 12 0 90 0 1 1 0 0 0|12 60 60 0 60 0 1 1 0 0 0|55 0 70 0 3 0 1 1 0 0 0|40 0 50 0 70 0 1 1 0 0 0|2 0 120 0 80 0 1 1 1 0 0|70 40 60 0 80 0 1 1 0 0 0|80 0 4 100 6 100 1 1 0 0 0|100 0 9 0 8 0 1 1 0 0 0
90 0 80 0 70 0 1 1 0 0 1|120 5 60 0 50 0 1 1 0 0 1|75 8 120 0 90 0 1 1 0 0 1|200 2 45 0 45 0 1 1 0 0 1
12 0 9 0 60 0 0 1 1 400 1|3 0 12 0 90 0 0 1 1 200 1|1 0 40 0 30 0 0 1 0 300 1|60 0 12 0 45 0 0 1 0 500 1|150 2 60 0 80 0 0 1 0 900 1|45 12 60 0 70 0 0 1 0 350 1|30 25 40 0 9 0 0 1 0 220 1|20 35 50 5 30 0 0 1 0 120 1|400 0 3 0 12 0 0 1 0 420 1|14 0 0 0 0 0 0 1 0 14 1|7 0 9 0 9 100 0 1 0 80 1|2 0 5 100 6 100 0 1 0 2 1|10 0 1 0 1 0 0 1 0 12 1|4 25 3 0 2 0 0 1 0 9 1|1 0 0 0 0 0 0 1 0 1 1|3 0 25 0 2 100 0 1 1 60 1|9 0 7 100 2 100 0 1 1 9 1|5 0 1 100 25 0 0 1 0 5 1
2 100 60 0 50 0 0 1 0 200 1|4 100 30 0 3 100 0 1 0 150 1|3 100 3 100 3 100 0 1 0 90 1|2 100 2 100 2 100 0 1 0 60 1|6 85 30 0 0 0 0 1 0 80 1|12 95 40 0 9 100 0 1 0 70 1|9 90 9 90 9 90 0 1 0 55 1|1 100 80 0 90 0 0 1 0 300 1|5 100 4 100 30 0 0 1 0 40 1|1 100 1 100 1 100 0 1 0 70 1
1 100 1 100 1 100 0 1 0 0 0|2 100 1 100 2 100 0 1 0 0 0|1 100 2 100 1 100 0 1 0 2 0|3 100 3 100 2 100 0 1 0 0 0|1 100 90 0 1 100 0 1 0 0 0|2 100 1 100 60 0 0 1 0 1 0|4 100 3 100 4 100 0 1 0 0 0
12 0 1 100 9 0 0 -1 0 12 0|25 0 2 100 60 0 0 -1 0 25 0|120 0 60 0 9 0 0 -1 0 240 0|4 0 0 0 30 0 0 -1 1 40 0|60 5 30 0 80 0 0 -1 0 90 0|5 100 4 100 3 100 0 -1 0 0 0|35 0 120 0 3 0 0 -1 0 35 0|9 0 200 0 0 0 0 -1 0 9 0|300 0 30 0 40 0 0 -1 0 500 0
1 100 1 100 1 100 0 0 0 0 0|3 100 0 0 2 100 0 0 0 3 0|4 75 5 80 3 60 0 0 0 6 0|8 60 4 100 6 50 0 0 0 9 0|20 70 8 90 7 100 0 0 0 15 0|35 55 10 100 12 90 0 0 0 30 0|14 45 3 100 5 100 0 0 0 20 0|5 100 60 0 4 100 0 0 0 0 0|2 100 2 100 2 100 0 0 0 4 0|40 90 30 80 30 90 0 0 0 10 0
3 0 0 0 2 100 0 0 0 3 0|2 0 3 100 4 0 0 0 0 6 0|5 0 4 0 3 0 0 0 0 12 0|7 0 2 100 6 0 0 0 0 13 0|9 0 5 0 6 0 0 0 0 20 0|8 0 3 0 4 100 0 0 0 11 0|6 0 6 100 9 0 0 0 1 15 0|4 0 2 100 3 100 0 0 1 4 0|1 0 0 0 0 0 0 0 0 1 0|10 0 1 0 1 0 0 0 0 12 0|11 0 2 100 1 0 0 0 0 12 0|3 0 2 100 2 100 0 0 1 3 0|6 0 60 0 0 0 0 0 0 6 0|8 0 45 0 3 100 0 0 0 8 0|12 0 30 0 4 100 0 0 0 12 0
60 0 5 0 50 0 0 0 0 120 1|35 5 60 0 40 0 0 0 0 240 1|22 0 30 0 80 0 0 0 0 132 1|90 10 6 0 4 0 0 0 0 90 1|28 20 45 0 2 100 0 0 0 70 1|120 0 1 100 90 0 0 0 0 300 1|17 0 60 0 70 0 0 0 0 150 1|25 0 9 0 7 0 0 0 0 60 1|300 0 0 0 0 0 0 0 0 300 1|40 0 3 100 2 100 0 0 0 40 1|65 0 8 0 3 100 0 0 0 65 1|30 0 80 0 90 0 0 0 0 30 1
9 0 60 0 55 0 0 0 0 180 1|4 0 70 0 80 0 0 0 0 200 1|7 0 120 0 40 0 0 0 0 220 1|3 0 3 0 4 0 0 0 0 150 1|5 0 2 0 60 0 0 0 0 130 1|6 0 80 0 3 100 0 0 0 140 1|2 0 4 0 2 0 0 0 0 90 1|8 0 50 0 1 100 0 0 0 110 1|12 0 40 5 35 0 0 0 0 95 1|1 0 3 0 2 0 0 0 0 80 1|10 0 90 0 0 0 0 0 0 100 1
6 0 30 0 90 0 0 0 1 120 1|10 0 8 100 60 0 0 0 1 70 1|5 0 80 0 75 0 0 0 1 160 1|3 0 4 0 5 0 0 0 1 90 1|8 0 1 100 40 0 0 0 1 48 1|2 0 60 0 30 0 0 0 1 95 1|7 0 2 100 30 0 0 0 1 7 1|5 0 1 100 50 0 0 0 1 5 1
2 100 60 0 50 0 0 0 0 112 1|4 100 40 0 4 100 0 0 0 90 1|3 100 3 100 3 100 0 0 0 120 1|6 80 70 0 60 0 0 0 0 135 1|5 100 4 100 45 0 0 0 0 100 1
"""


def labelled() -> list[tuple[list[float], int]]:
    rows = [[int(x) for x in row.split()] for line in LABELLED.split("\n") for row in line.split("|") if row.strip()]
    return [(r[:-1], r[-1]) for r in rows]


@cache
def tree():
    """The tree of the labelled table."""
    return grow(labelled())


def grow(rows: list[tuple[list[float], int]], depth: int = 7):
    """A tree of (feature, threshold, at most, above) by Gini impurity; a leaf is its majority label."""
    ones = sum(y for _, y in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones > len(rows))
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            low = [y for x, y in rows if x[f] <= cut]
            n, k = len(low), sum(low)
            m, j = len(rows) - n, ones - k
            impurity = n - (k * k + (n - k) ** 2) / n + m - (j * j + (m - j) ** 2) / m
            if best is None or impurity < best[0] - 1e-9:
                best = (impurity, f, cut)
    if best is None:
        return int(2 * ones > len(rows))
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[0][f] <= cut], depth - 1), grow([r for r in rows if r[0][f] > cut], depth - 1)


def decide(tree, features) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def kind(name: str, rest: str) -> str:
    """What a container is by its tag and attributes: main, outside (never the article), weak (by class), header or ''."""
    said: list[set[str]] = []
    role = ""
    if "=" in rest or "hidden" in rest:
        for m in ATTRIBUTE.finditer(rest):
            key, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                said += [set(WORDS.findall(x)) for x in value.split()]
            elif key == "role":
                role = value.strip()
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "outside"
    if name in ("html", "body"):
        return ""
    if any(x & REPLIES and x <= REPLIES | MARKS | PLAIN for x in said):
        return "outside"
    if name in OUTSIDE or role in ROLES:
        return "outside"
    if name in MAIN or role in ("main", "article"):
        return "main"
    return "weak" if any(x & MARKS and x <= MARKS | PLAIN for x in said) else "header" if name == "header" else ""


#: What encloses a place: mark, main, heading, section.
NOWHERE = (0, 0, 0, 0)


def entered(now: tuple, name: str, what: str, section: int) -> tuple:
    """What encloses a place in a container of that name and kind; section is the container's own number, if it is one."""
    mark, main, heading, own = now
    if what == "outside":
        mark = 2
    elif what == "weak":
        mark = max(mark, 1)
    elif what == "header":
        mark = max(mark, 1 - main)
    elif what == "main":
        main, mark = 1, 2 if mark == 2 else 0
    return mark, main, heading | (name in HEADINGS), own if name in FLOW else section


def blocks(page: str) -> list[list]:
    """[text, words, linked words, mark, main, heading, section] of each block that has text, in page order.

    One pass: each open element keeps what encloses its content, and each name the places where it is open, so that
    nothing walks up the whole stack.
    """
    out: list[list] = []
    stack: list[tuple[str, tuple]] = []
    where: dict[str, list[int]] = {}
    parts: list[str] = []
    linked = sections = 0
    now = NOWHERE

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                n = text.count(" ") + 1
                out.append([text, n, min(linked, n), *now])
            parts, linked = [], 0

    def said(text: str) -> None:
        nonlocal linked
        text = html.unescape(text) if "&" in text else text
        parts.append(text)
        if where.get("a"):
            linked += len(text.split())

    def leave(k: int) -> None:
        """Close the elements from the k-th on."""
        while len(stack) > k:
            open_ = where[stack.pop()[0]]
            if open_ and open_[-1] == len(stack):
                open_.pop()

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            said(page[at:])
            break
        if m.start() > at:
            said(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name, closing, rest = name.lower(), m["end"] or m["end2"], m["rest"] or m["rest2"] or ""
        if name not in INLINE or name == "br":
            if name == "br":
                parts.append(" ")
                continue
            flush()
        if closing:
            if where.get(name):
                k = where[name][-1]
                if name in INLINE and any(stack[i][0] not in INLINE for i in range(len(stack) - 1, k, -1)):
                    where[name].pop()  # what was opened within it stays open
                else:
                    leave(k)
        elif name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
            at = close.end()
        elif name not in VOID:
            # a paragraph, an item or a link ends where the next one begins
            if name in ("p", "li", "a", "dt", "dd", "tr", "td", "th", "option"):
                alike = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}.get(name, (name,))
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in alike:
                        leave(i)
                        break
                    if stack[i][0] not in INLINE and stack[i][0] != "p":
                        break
            if not rest.rstrip().endswith("/") or name not in INLINE:
                sections += name not in FLOW
                where.setdefault(name, []).append(len(stack))
                stack.append((name, entered(stack[-1][1] if stack else NOWHERE, name, kind(name, rest), sections)))
        now = (stack[-1][1] if stack else NOWHERE) if name not in INLINE or not parts else now
    flush()
    return out


def described(found: list[list]) -> list[tuple]:
    """Features of each block, neighbours included; a missing neighbour has no words and no links."""
    share = [round(100 * b[2] / b[1]) for b in found]
    size = [b[1] for b in found]
    beside: dict[int, int] = {}
    for b in found:
        if not b[3]:
            beside[b[6]] = beside.get(b[6], 0) + b[1] - b[2]
    away = -1 if any(b[4] for b in found) else 0
    pad = lambda x: [0, *x, 0]
    size_, share_ = pad(size), pad(share)
    return [
        (b[1], share[i], size_[i], share_[i], size_[i + 2], share_[i + 2], b[3], b[4] or away, b[5], 0 if b[3] else beside[b[6]])
        for i, b in enumerate(found)
    ]


def main_text(page: str | None, tree) -> tuple[str, int]:
    """The article's blocks joined by a space, and the number of all blocks."""
    found = blocks(page or "")
    return " ".join(b[0] for b, x in zip(found, described(found)) if decide(tree, x)), len(found)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of every row of pages (page_id, url, html).

    Null and empty pages, and pages without an article, give an empty text; nothing is cut. Rows are independent, so
    repeated ones give repeated results, null ids and urls are passed on, and an empty table gives an empty result.
    """
    rules = tree()

    def make():
        def each(batch):
            got = [main_text(page, rules) for page in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

        return each

    return common.scan(pages.select("page_id", F.col("url").cast("string").alias("url"), "html"), make, "page_id long, url string, text string, n_chars long, n_blocks long", 256)
