"""Main text of HTML pages: a page becomes a flat list of text blocks, each
block is described by its own and its neighbours' word count and link density
and by the place it stands in, and a decision tree trained on the small
labelled table below says which blocks are article text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by their role.
RAW = "script style"  # their text is no markup; left open, they run to the end of the page
HIDE = "noscript template svg math iframe object canvas textarea select button title"  # left out with their content
_HIDDEN_TAGS = set(HIDE.split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
             "strike strong sub sup time tt u var".split())
CHROME = set("nav aside footer form dialog menu fieldset".split())
ARTICLE = set("article main".split())
# Words of class and id attributes that name page furniture, and words that name the text itself.
HINTS = set("ad ads advert adverts advertisement sponsor sponsored promo banner sidebar side menu nav navbar navigation "
            "breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices popup modal overlay "
            "newsletter subscribe signup login share sharing social related recommended toolbar pagination widget".split())
READERS = set("comment comments reply replies disqus".split())
TEXT = set("article post entry content main story body text".split())

_SKIP = (r"<!--.*?(?:-->|\Z)"
         rf"|<(?P<raw>{'|'.join(RAW.split())})(?=[\s/>])(?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*>.*?(?:</(?P=raw)\s*>|\Z)")
_TOKEN = re.compile(
    _SKIP + r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/><]*)(?P<attrs>(?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*|[^>]*)>"
    r"|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_HIDE = re.compile(
    _SKIP + rf"|<(?P<end>/?)(?P<tag>{'|'.join(HIDE.split())})(?=[\s/>])(?P<attrs>(?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*|[^>]*)>", re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
# First parts of class names that tell a state of what is around them, not what they are.
STATES = set("no has have with without is not hide hides show shows enable enabled disable disabled allow open can uses".split())

#: Labelled blocks: words, link density, words and link density of the block before and of the block behind,
#: place (0 open page, 1 article, 2 page furniture), heading (1) or not, article text (1) or not.
LABELLED = """
8 1.0 0 0 6 1.0 0 0 0
6 1.0 8 1.0 7 1.0 0 0 0
5 1.0 6 1.0 60 0.0 0 0 0
2 1.0 2 1.0 2 1.0 0 0 0
1 1.0 1 1.0 1 1.0 0 0 0
3 1.0 2 1.0 9 0.0 0 1 0
12 0.8 5 1.0 11 0.9 0 0 0
20 0.7 18 0.9 22 0.8 0 0 0
7 0.5 4 1.0 5 1.0 0 0 0
4 0.0 3 1.0 2 1.0 0 0 0
5 0.0 2 1.0 0 0 0 0 0
9 0.1 4 1.0 0 0 0 0 0
3 0.0 0 0 4 1.0 0 0 0
1 1.0 0 0 60 0.0 0 0 0
2 1.0 0 0 60 0.0 0 0 0
6 1.0 0 0 90 0.0 0 0 0
4 0.9 0 0 8 0.0 0 1 0
1 1.0 55 0.0 0 0 0 0 0
2 1.0 40 0.0 0 0 0 0 0
3 1.0 50 0.0 45 0.0 0 0 0
9 1.0 70 0.0 30 0.0 0 0 0
2 0.0 5 0.9 6 1.0 0 0 0
6 0.0 2 1.0 70 0.0 0 1 1
9 0.0 0 0 80 0.0 0 1 1
8 0.0 50 0.0 44 0.0 0 1 1
60 0.0 6 0.0 75 0.0 0 0 1
75 0.0 60 0.0 80 0.1 0 0 1
80 0.1 75 0.0 45 0.0 0 0 1
45 0.0 80 0.1 3 0.0 0 0 1
3 0.0 45 0.0 52 0.0 0 0 1
12 0.0 35 0.0 40 0.0 0 0 1
30 0.2 40 0.0 25 0.0 0 0 1
25 0.0 30 0.2 4 1.0 0 0 1
18 0.0 22 0.0 19 0.1 0 0 1
22 0.0 7 0.0 18 0.0 0 0 1
40 0.0 0 0 0 0 0 0 1
14 0.0 0 0 0 0 0 0 1
150 0.05 5 1.0 6 1.0 0 0 1
2 0.0 30 0.0 28 0.0 0 0 1
10 0.0 3 1.0 12 0.0 1 1 1
60 0.0 10 0.0 55 0.0 1 0 1
55 0.0 60 0.0 2 0.0 1 0 1
2 0.0 55 0.0 1 0.0 1 0 1
1 0.0 2 0.0 8 1.0 1 0 1
8 1.0 30 0.0 20 0.0 1 0 1
20 0.6 8 1.0 5 0.0 1 0 1
5 0.0 4 1.0 3 1.0 1 0 1
7 0.0 0 0 0 0 1 0 1
1 1.0 1 1.0 1 1.0 2 0 0
4 1.0 3 1.0 10 0.0 2 0 0
12 0.0 4 1.0 60 0.0 2 0 0
18 0.0 80 0.0 0 0 2 0 0
45 0.0 30 0.0 50 0.0 2 0 0
90 0.0 60 0.0 70 0.0 2 0 0
30 0.1 70 0.0 20 0.0 2 0 0
3 0.0 60 0.0 45 0.0 2 1 0
8 0.0 0 0 0 0 2 0 0
6 0.2 12 0.0 4 1.0 2 0 0
"""


def labelled() -> tuple[np.ndarray, np.ndarray]:
    t = np.array([[float(v) for v in line.split()] for line in LABELLED.strip().splitlines()])
    return t[:, :-1], t[:, -1].astype(int)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """CART by Gini impurity: ``(share of ones,)`` at a leaf, else
    ``(feature, limit, subtree at or below, subtree above)``."""
    if depth == 0 or len(set(y)) < 2:
        return (float(y.mean()),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            gini = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(cut), low)
    if best is None:
        return (float(y.mean()),)
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def judge(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Share of article text in the leaf of every row."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    f, cut, below, above = tree
    low, out = x[:, f] <= cut, np.empty(len(x))
    out[low], out[~low] = judge(below, x[low]), judge(above, x[~low])
    return out


def _hides(attrs: str) -> bool:
    """Do the attributes hide their element? The bare ``hidden`` attribute,
    ``aria-hidden="true"`` and ``display:none`` in a style do."""
    if "hidden" not in (low := attrs.lower()) and "display" not in low:
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if name == "hidden" and not value.startswith("until") or name == "aria-hidden" and value == "true" or (
                name == "style" and _NONE.search(value)):
            return True
    return False


def _place(tag: str, attrs: str, outer: int, forms: bool = True) -> int:
    """Place of what stands in an element: 3 is furniture that an article
    inside it does not undo (reader comments, forms, menus, hidden parts).
    Without ``forms`` a form is like any other element."""
    if outer == 3:
        return 3
    names: set[str] = set()
    if "=" in attrs:
        for m in _NAMED.finditer(attrs):
            for name in (m[2] or m[3] or m[4] or "").lower().split():
                parts = re.split(r"[^a-z0-9]+", name)
                if parts[0] not in STATES or len(parts) == 1:
                    names.update(parts)
    if (tag in CHROME and (forms or tag != "form")) or names & READERS or (attrs and _hides(attrs)):
        return 3
    if tag in ARTICLE and not names & HINTS:
        return 1
    if tag in ("html", "body"):
        return outer
    if (tag == "header" and outer != 1) or (names & HINTS and not names & TEXT):
        return 2
    return outer


def hidden_ends(page: str) -> dict[int, int]:
    """Start of each ``HIDE`` element -> end of its end tag. Elements that are
    empty or have no end tag of their own are absent."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for m in _HIDE.finditer(page):
        if not m["tag"]:
            continue
        starts = open_.setdefault(m["tag"].lower(), [])
        if not m["end"]:
            if not (m["attrs"].endswith("/") and m["tag"].lower() in ("svg", "math")):
                starts.append(m.start())
        elif starts:
            out[starts.pop()] = m.end()
    return out


def blocks(page: str, forms: bool = True) -> list[tuple[str, int, int, int, int]]:
    """``(text, words, words in links, place, heading)`` of each text block in
    page order; markup that never shows is gone, references are decoded. A form
    around most words of the page is its wrapper, not a form to fill in."""
    out: list[tuple[str, int, int, int, int]] = []
    stack: list[tuple[str, int]] = []  # open elements with the place of their content
    open_: Counter = Counter()  # and how many there are of each name
    parts: list[str] = []
    linked, links, heading, in_forms = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked, in_forms
        words = "".join(parts).split()
        if words:
            in_forms += len(words) if open_["form"] else 0
            place = stack[-1][1] if stack else 0
            out.append((" ".join(words), len(words), min(linked, len(words)), min(place, 2), heading))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text)
            parts.append(text)
            if links:
                linked += len(text.split())

    def close(depth: int) -> None:
        nonlocal links, heading
        for tag, _ in stack[depth:]:
            open_[tag] -= 1
            links -= tag == "a"
            if len(tag) == 2 and tag[0] == "h":
                heading = 0
        del stack[depth:]

    at = 0
    shut_page = page + ">"  # the sign closes a tag that the page leaves open, so none is searched for twice
    ends = hidden_ends(shut_page)
    while m := _TOKEN.search(shut_page, at):
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"]:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _HIDDEN_TAGS and not m["end"]:
            flush()
            at = ends.get(m.start(), at)  # without an end tag only the tag itself is left out
            continue
        if m["end"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None) if open_[tag] else None
            if tag not in INLINE or (depth is not None and any(p != (stack[depth - 1][1] if depth else 0)
                                                               for _, p in stack[depth:])):
                flush()
            if depth is not None:
                close(depth)
            continue
        if tag in VOID or tag == "head":  # the head may be left open; what it holds is void, raw or hidden anyway
            if tag in ("hr", "head"):
                flush()
            continue
        outer = stack[-1][1] if stack else 0
        if tag not in INLINE:
            flush()
            shut = ("p",) if tag != "li" else ("li", "p")
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, an item the item before it
                if stack[k][0] in shut:
                    close(k)
                    outer = stack[-1][1] if stack else 0
                    break
                if stack[k][0] not in INLINE:
                    break
        if m["attrs"].endswith("/"):
            continue
        place = _place(tag, m["attrs"], outer, forms)
        if tag in INLINE and place != outer:
            flush()
        stack.append((tag, place))
        open_[tag] += 1
        links += tag == "a"
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            heading = 1
    say(page[at:])
    flush()
    if forms and 2 * in_forms > sum(b[1] for b in out):
        return blocks(page, forms=False)
    return out


def features(rows: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    """One row per block, the columns of ``LABELLED`` without the label."""
    n = np.array([r[1] for r in rows], float)
    d = np.array([r[2] for r in rows], float) / np.maximum(n, 1)
    back, ahead = (lambda v: np.r_[0, v[:-1]]), (lambda v: np.r_[v[1:], 0])
    return np.column_stack([n, d, back(n), back(d), ahead(n), ahead(d), [r[3] for r in rows], [r[4] for r in rows]])


def main_text(pages: list[str | None], tree: tuple) -> list[str]:
    """Main text of each page; all their blocks are judged together."""
    found = [blocks(p or "") for p in pages]
    x = [features(f) for f in found if f]
    keep = iter(judge(tree, np.concatenate(x)) >= 0.5 if x else ())
    return [" ".join([b[0] for b in f if next(keep)]) for f in found]


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with a column ``text``: the main text.

    Null and empty html, and pages without article text, give the empty
    string. Repeated rows give repeated results; malformed markup is read as
    far as it goes (open elements end with their parent; an open comment, script
    or style takes the rest of the page; of other hidden elements without an end
    tag only the tag is left out); an empty table gives an empty one."""
    tree = grow(*labelled())

    @F.pandas_udf("string")
    def article(column):
        import pandas as pd
        return pd.Series(main_text([None if v is None else str(v) for v in column], tree), dtype="object")

    return pages.withColumn("text", article(F.col(html_col)))
