"""Main text of web pages: flat text blocks, features of a block and its neighbours, a decision tree.

A page is cut into blocks of text at block-level tags. Words, link density (of the block, the one before and the one
after) and the kind of element around the block feed a classification tree that is grown from the blocks of the pages
in labelled_pages.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, readable
from .labelled_pages import PAGES

#: Fixed values of the language: elements whose content is no text, and elements that do not break a block.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "title", "textarea", "select", "button", "head"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that hold no main text, and words of class, id or role that mark such elements; WEAK_WORDS may also name a
#: part of an article, so they are but a feature.
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ASIDE_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies",
    "disqus", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "popup", "promo", "replies", "respond",
    "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets",
}
#: Words that add nothing to a class name: one of an aside's words with others than these, as in "social-movements", is but weak.
PLAIN_WORDS = {
    "area", "article", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "center", "col", "column", "container", "content", "count", "cta", "footer", "form", "group", "header", "holder",
    "icon", "icons", "inline", "inner", "item", "items", "law", "leaderboard", "left", "link", "links", "list", "main", "message", "more", "notice", "outer", "page", "panel", "policy", "popular", "post", "posts",
    "primary", "related", "right", "row", "secondary", "section", "site", "slot", "small", "text", "thread", "title", "top", "unit", "us", "view", "wrap", "wrapper", "zone",
}
#: Elements that stand for text itself: inside a main element their class says nothing.
TEXT = {"p", "blockquote", "li", "dd", "dt", "td", "th", "tr", "pre", "figure", "figcaption"}
WEAK_WORDS = {"banner", "footer", "header", "notice", "notices", "related", "search"}
MAIN_WORDS = {"article", "articlebody", "main", "post", "entry", "story"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: A quoted value may hold > and, if it is followed by what may follow a value, also <; a tag with a broken quote ends at its >.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+|(?:[^<>\"']{1,200}|\"[^\"]{0,2000}\"(?=[\s/>])|'[^']{0,2000}'(?=[\s/>])){0,40}+|[^<>]*)>", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Za-z]+")


CLOSE = {tag: re.compile(rf"</{tag}\b[^>]*>" if tag != "head" else r"</head\b[^>]*>|(?=<body\b)", re.I) for tag in RAW}


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    tag: str
    main: bool
    asides: tuple[int, ...]  # where the elements begin that mark it as aside, the outermost first
    weak: bool
    at: int
    aside: bool = False

    @property
    def density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


def place(tag: str, attributes: str, in_main: bool = False) -> str:
    """What an element says of what it holds: aside, weak (perhaps aside), main or nothing."""
    if tag in ASIDE:
        return "aside"
    if tag in HEADINGS or in_main and tag in TEXT:
        return ""
    names = [{w.lower() for w in WORDS.findall(name)} for _, *values in ATTRIBUTE.findall(attributes) for v in values for name in v.split()] if attributes else []
    named = set().union(*names)
    if tag not in ("html", "body", "article", "main"):
        if any(n & ASIDE_WORDS and n <= ASIDE_WORDS | PLAIN_WORDS for n in names):
            return "aside"
        if tag == "header" or named & (WEAK_WORDS | ASIDE_WORDS):
            return "weak"
    return "main" if tag in ("article", "main") or named & MAIN_WORDS and tag not in ("html", "body") else ""


def blocks(page: str) -> list[Block]:
    """Blocks in page order, without markup; white space is one space, character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    asides: list[int] = []
    parts: list[str] = []
    linked: list[str] = []
    depth = {"main": 0, "aside": 0, "weak": 0, "": 0}
    in_link, tag_now, since = 0, "", 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            n = len(text.split())
            out.append(Block(text, n, min(n, len(html.unescape(" ".join(linked)).split())), tag_now, depth["main"] > 0, tuple(asides), depth["weak"] > 0, since))
        parts.clear()
        linked.clear()

    def close_one() -> str:
        tag, kind = stack.pop()
        depth[kind] -= 1
        if kind == "aside":
            asides.pop()
        return tag

    at, end = 0, len(page)
    unclosed: set[str] = set()
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            if not parts:
                since = at
            parts.append(text)
            if in_link:
                linked.append(text)
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if tag == "a":
            in_link = 0 if m[1] else 1
        if m[1]:
            if tag not in INLINE:
                flush()
            if any(t == tag for t, _ in stack):
                if tag in INLINE and not any(t == tag for t, _ in stack[-8:]):
                    continue
                while stack and close_one() != tag:
                    pass
            continue
        if tag in RAW and not m[0].endswith("/>") and not (tag == "button" and any(t == "p" for t, _ in stack[-4:])):  # a button in a sentence is a word of it
            if tag not in ("button", "select", "textarea"):
                flush()
            if tag not in unclosed:
                close = CLOSE[tag].search(page, at)
                if close:
                    at = close.end()
                elif tag in ("script", "style"):  # all that follows is theirs; other elements that never end hold nothing
                    at = end
                else:
                    unclosed.add(tag)
            continue
        if tag not in INLINE:
            flush()
            tag_now = tag
        if tag not in VOID and not m[0].endswith("/>"):
            kind = place(tag, m[3], depth["main"] > 0)
            if tag == "p":  # an open paragraph ends where the next one starts
                while stack and stack[-1][0] in INLINE | {"p"} and any(t == "p" for t, _ in stack):
                    close_one()
            stack.append((tag, kind))
            depth[kind] += 1
            if kind == "aside":
                asides.append(m.start())
    flush()
    held = wrappers(out)
    for b in out:
        b.aside = any(a not in held for a in b.asides)
    return out


def wrappers(found: list[Block]) -> set[int]:
    """Elements that look like asides but hold the page, as a form around all of it: prose of some length, and no prose
    outside of them but in other asides. The outermost is looked at first, then what stands inside it."""
    prose = [b for b in found if b.words - b.link_words >= PROSE and b.density < 0.5]
    held: set[int] = set()
    while prose:
        outside = [b for b in prose if all(a in held for a in b.asides)]
        words: dict[int, int] = {}
        for b in prose:
            first = next((a for a in b.asides if a not in held), None)
            if first is not None:
                words[first] = words.get(first, 0) + b.words - b.link_words
        best = max(words, key=lambda a: (words[a], -a), default=None)
        if outside or best is None or words[best] < WRAPPED:
            break
        held.add(best)
    return held


#: Words of a block of prose, and those that an element needs to be the page's wrapper.
PROSE, WRAPPED = 10, 50

FEATURES = ("words", "density", "before_words", "before_density", "after_words", "after_density", "main", "aside", "weak", "heading", "main_page")


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """Features of each block; main_page is 1 if any block of the page stands in a main element."""
    main_page = float(any(b.main for b in found))
    rows = []
    for k, b in enumerate(found):
        p, q = (found[k - 1] if k else None), (found[k + 1] if k + 1 < len(found) else None)
        rows.append((b.words, b.density, p.words if p else 0, p.density if p else 0.0, q.words if q else 0, q.density if q else 0.0, float(b.main), float(b.aside), float(b.weak), float(b.tag in HEADINGS), main_page))
    return rows


def labelled_blocks(page: list[tuple[int, str]]) -> list[tuple[float, ...]]:
    """FEATURES of the blocks of a page that is given as labelled pieces of html, then the label."""
    ends = list(accumulate(len(piece) for _, piece in page))
    found = blocks("".join(piece for _, piece in page))
    return [(*row, page[bisect_right(ends, b.at)][0]) for b, row in zip(found, features(found), strict=True)]


def grow(rows: list[tuple[float, ...]], depth: int = 8) -> tuple | float:
    """A tree of (feature, threshold, low side, high side), split where it lowers Gini impurity most; a leaf is the share of label 1."""
    share = sum(r[-1] for r in rows) / len(rows)
    if depth == 0 or share in (0.0, 1.0):
        return share
    best: tuple | None = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            a, b = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            impurity = sum(len(s) * (p := sum(r[-1] for r in s) / len(s)) * (1 - p) for s in (a, b))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut, a, b)
    if best is None:
        return share
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


@lru_cache(maxsize=1)
def tree() -> tuple | float:
    return grow([row for page in PAGES for row in labelled_blocks(page)])


def is_main(row: tuple[float, ...]) -> bool:
    node = tree()
    while isinstance(node, tuple):
        f, cut, low, high = node
        node = low if row[f] <= cut else high
    return node >= 0.5


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, row in zip(found, features(found), strict=True) if is_main(row))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: id, url, text, n_chars (code points).

    Null or empty html, and pages without main text, give an empty text and 0. Pages count whole, however long; repeated
    rows stay repeated; an empty table stays empty; damaged markup is read as far as it goes, and bytes that are no UTF-8
    count as U+FFFD. Ids may be of any type, there are no ties, and other columns are not looked at.
    """
    src = pages.selectExpr(f"`{id_col}` AS page_id", f"cast(`{url_col}` AS string) AS url", f"cast(`{html_col}` AS string) AS html")

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in readable(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    out = arrow_map(src, run, f"page_id {src.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
    return out.withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)
