"""HTML table scan (SRC-6, SRC-7).

Pages are parsed where they live: ``mapInArrow`` runs a small scan per page
inside the executors, and emits one row per table. Plain markup (every ``<``
starts a simple tag) is cut by one regular expression and read in one pass; of
any other page the stdlib ``html.parser`` gives the same tree. Selection follows the DOM rules of ``querySelectorAll``: rows
are all descendant row elements of a container, cells all descendant cell
elements of a row, and a cell's text is its ``textContent`` trimmed.

Spark has no HTML tree parser; a regex cannot follow nesting or implied end
tags, so this is the one place where Python runs per row (Arrow batches).
"""

from __future__ import annotations

import re
import sys
from html import unescape
from html.parser import HTMLParser
from typing import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that never have children.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
# An opening tag closes an open element of these kinds first
# (the implied end tags a browser applies inside lists and tables).
IMPLIED_CLOSE = {
    "li": ("li",),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
# Elements whose implied closing stops at these boundaries.
SCOPE_BOUNDARY = {
    "li": ("ul", "ol"),
    "tr": ("table", "tbody", "thead", "tfoot"),
    "td": ("tr", "table"),
    "th": ("tr", "table"),
    "option": ("select",),
}


# JavaScript String.prototype.trim: WhiteSpace and LineTerminator.
_JS_SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(s: str) -> str:
    return s.strip(_JS_SPACE)


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: list):
        self.tag = tag
        self.attrs = attrs  # raw (name, value) pairs; only the container's class is read
        self.children: list = []  # _Node or str

    def css_classes(self) -> list[str]:
        for k, v in self.attrs:
            if k == "class":
                return (v or "").split()
        return []

    def text(self) -> str:
        out: list[str] = []
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def descendants(self, tags: Sequence[str]):
        """Descendant elements with one of ``tags``, in document order."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                continue
            if n.tag in tags:
                yield n
            stack.extend(reversed(n.children))


def _imply_close(stack: list[_Node], tag: str) -> None:
    closes = IMPLIED_CLOSE.get(tag)
    if closes:
        bounds = SCOPE_BOUNDARY[tag]
        for k in range(len(stack) - 1, 0, -1):
            t = stack[k].tag
            if t in bounds:
                break
            if t in closes:
                del stack[k:]
                break


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#document", [])
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        _imply_close(self.stack, tag)
        node = _Node(tag, attrs)
        self.stack[-1].children.append(node)
        if tag not in VOID_TAGS:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(_Node(tag, attrs))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


_BLANK = r"[ \t\n\r\f]"
_TAG = re.compile(rf"<(/?)([a-zA-Z][-a-zA-Z0-9]*)((?:{_BLANK}+[a-zA-Z_][-\w]*(?:=(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'=<>`/]+))?)*){_BLANK}*(/?)>")
_ATTR = re.compile(r"([a-zA-Z_][-\w]*)(?:=(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`/]+)))?")
# Elements whose content is not markup; pages with one of them go to the full parser.
_RAW = re.compile(r"<(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)\b", re.I)


def _attributes(text: str) -> list[tuple[str, str | None]]:
    out = []
    for m in _ATTR.finditer(text):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
        out.append((m[1].lower(), None if value is None else unescape(value)))
    return out


def plain_tree(html: str) -> _Node | None:
    """The tree of a page of plain markup; None if it is not plain."""
    if _RAW.search(html):
        return None
    parts = _TAG.split(html)  # text, (end, name, attributes, closed), text, ...
    if html.count("<") != len(parts) // 5:
        return None
    root = _Node("#document", [])
    stack = [root]
    for at in range(0, len(parts), 5):
        text = parts[at]
        if text:
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if at + 1 == len(parts):
            break
        end, tag, attrs, closed = parts[at + 1:at + 5]
        tag = tag.lower()
        if end:
            if attrs or closed:
                return None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if not closed:
            _imply_close(stack, tag)
        node = _Node(tag, _attributes(attrs) if attrs else [])
        stack[-1].children.append(node)
        if not closed and tag not in VOID_TAGS:
            stack.append(node)
    return root


# Roles an element can have in a scan (bits); an end tag has none.
_CELL, _ROW, _CONTAINER, _END = 1, 2, 4, -1
# Tag texts a scan remembers, and their length; beyond that a tag is read again each time it occurs.
KNOWN_TAGS, KNOWN_LENGTH = 10_000, 200
_PIECE = re.compile("(<[^<>]*)>([^<]*)")


class _Tags(dict):
    """``tag text without its > -> (name, role, closes, bounds, childless)``; None if it is not a plain tag."""

    def __init__(self, container: str, row: str, cells: tuple, css_class: str | None):
        self.container, self.row, self.cells, self.css_class = container, row, cells, css_class

    def __missing__(self, text: str) -> tuple | None:
        t = self._read(text)
        if len(self) < KNOWN_TAGS and len(text) <= KNOWN_LENGTH:
            self[text] = t
        return t

    def _read(self, text: str) -> tuple | None:
        m = _TAG.fullmatch(text + ">")
        if m is None or _RAW.match(m[0]):
            return None
        end, name, attrs, closed = m[1], sys.intern(m[2].lower()), m[3], m[4]
        if end:
            return None if attrs or closed else (name, _END, None, None, False)
        role = _CELL * (name in self.cells) + _ROW * (name == self.row)
        if name == self.container and (self.css_class is None or self.css_class in _Node(name, _attributes(attrs)).css_classes()):
            role += _CONTAINER
        closes = None if closed else IMPLIED_CLOSE.get(name)
        return name, role, closes, SCOPE_BOUNDARY.get(name), bool(closed) or name in VOID_TAGS


class PlainScan:
    """Rows of cell texts of every matching container of a page of plain
    markup, in one pass: what a selection over ``plain_tree`` gives, without the
    tree. What a tag does depends on its text alone (name, class, end), so it
    is worked out once for each text that occurs."""

    def __init__(self, container: str, row: str, cells: Sequence[str], css_class: str | None):
        self.known = _Tags(container, row, tuple(cells), css_class)
        self.whole_row = not cells

    def tables(self, html: str) -> list[list[list[list[str]]]] | None:
        """Per container its rows, per row its cells, per cell the texts in it; None if the page is not plain."""
        n = html.count("<")
        if html.count(">") == n:  # tag and text by turns, if each tag proves to begin with its <
            parts = html.replace("<", "><").split(">")
            pieces = zip(parts[1::2], parts[2::2])
        else:
            pieces = _PIECE.findall(html)
            if len(pieces) != n:
                return None
        known, whole_row = self.known, self.whole_row
        out: list = []
        tags, roles = [""], [0]  # open elements, the document first
        tables: list = []  # what the open containers,
        rows: list = []  # rows
        texts: list = []  # and cells have so far
        keep = 0  # elements from here on end before the tag

        for name, text in pieces:
            t = known[name]
            if t is None:
                return None
            tag, role, closes, bounds, childless = t
            if role < 0:
                if tags[-1] == tag:
                    if roles[-1] > 1:
                        keep = len(tags) - 1
                    else:
                        tags.pop()
                        if roles.pop():
                            texts.pop()
                elif tag in tags:
                    keep = len(tags) - 1 - tags[::-1].index(tag)
            elif closes and tags[-1] not in bounds:
                for k in range(len(tags) - 1, 0, -1):
                    if tags[k] in bounds:
                        break
                    if tags[k] in closes:
                        keep = k
                        break
            if keep:
                for r in roles[keep:]:
                    if r & _CELL or r & _ROW and whole_row:
                        texts.pop()
                    if r & _ROW:
                        rows.pop()
                    if r & _CONTAINER:
                        tables.pop()
                del tags[keep:], roles[keep:]
                keep = 0
            if role >= 0:
                # an element belongs to the open ones around it, not to itself
                if role == 1:  # a cell, the most common
                    own: list = []
                    for r in rows:
                        r.append(own)
                    if not childless:
                        texts.append(own)
                elif role:
                    own = []  # its texts
                    row, table = [own] if whole_row else [], []
                    if role & _CELL:
                        for r in rows:
                            r.append(own)
                    if role & _ROW:
                        for x in tables:
                            x.append(row)
                    if role & _CONTAINER:
                        out.append(table)
                    if not childless:
                        if role & _CELL or role & _ROW and whole_row:
                            texts.append(own)
                        if role & _ROW:
                            rows.append(row)
                        if role & _CONTAINER:
                            tables.append(table)
                if not childless:
                    tags.append(tag)
                    roles.append(role)
            if texts and text:
                if "&" in text:  # the plain ampersand is the most common reference
                    text = text.replace("&amp;", "&") if text.count("&") == text.count("&amp;") else unescape(text)
                for x in texts:
                    x.append(text)
        return out


def full_tree(html: str) -> _Node:
    b = _TreeBuilder()
    try:
        b.feed(html)
        b.close()
    except AssertionError:  # a marked section the parser does not know: read its opening as text
        b = _TreeBuilder()
        b.feed(html.replace("<![", "&lt;!["))
        b.close()
    return b.root


def _tree_tables(html: str, container: str, row: str, cells: tuple, css_class: str | None) -> list[list[list[list[str]]]]:
    """What ``PlainScan.tables`` gives, by the page's tree."""
    out = []
    for t in full_tree(html).descendants((container,)):
        if css_class is None or css_class in t.css_classes():
            out.append([[[c.text()] for c in r.descendants(cells)] if cells else [[r.text()]] for r in t.descendants((row,))])
    return out


def parse_tables(html: str | None, container: str = "table", row: str = "tr",
                 cells: Sequence[str] = ("td", "th"), css_class: str | None = None,
                 min_rows: int = 2, scan: PlainScan | None = None) -> list[list[list[str]]]:
    """All containers with at least ``min_rows`` row elements, as lists of
    rows of trimmed cell texts; rows without cells are left out. With empty
    ``cells`` the row's own text is its single cell. ``scan`` is the scan of
    these arguments where many pages are read."""
    if not html:
        return []
    found = (scan or PlainScan(container, row, cells, css_class)).tables(html)
    if found is None:
        found = _tree_tables(html, container, row, tuple(cells), css_class)
    out = []
    for t in found:
        if len(t) >= min_rows:
            data = [[js_trim(c[0] if len(c) == 1 else "".join(c)) for c in r] for r in t if r]
            if data:
                out.append(data)
    return out


def html_rows(df: DataFrame, html_col: str = "html", id_cols: Sequence[str] = ("page_id",), *,
              container: str = "table", row: str = "tr", cells: Sequence[str] = ("td", "th"),
              css_class: str | None = None, first_only: bool = True,
              min_data_rows: int = 2) -> DataFrame:
    """SRC-6/SRC-7 scan: ``(id_cols..., table_no, row_no, cells, header)``;
    ``header`` is row 0 of the same table, carried on every row so binding
    needs no join.

    ``row_no`` is 0-based among rows that have cells (row 0 is the header).
    ``first_only`` keeps only the first container with at least
    ``min_data_rows`` rows that have cells, as the table fallback does.
    Work is split by the input partitions; each page is parsed once.
    """
    id_cols = list(id_cols)
    id_fields = [df.schema[c] for c in id_cols]
    quote = lambda c: "`" + c.replace("`", "``") + "`"  # noqa: E731  (this module ships by value and imports no sibling)
    # a table leaves Python as one row; its rows and header are taken apart in the JVM
    out_schema = T.StructType(id_fields + [
        T.StructField("table_no", T.IntegerType(), False),
        T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType(), False), False), False),
    ])
    cells_t = tuple(cells)

    table_type = pa.list_(pa.list_(pa.string()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = PlainScan(container, row, cells_t, css_class)
        for b in batches:
            rows, numbers, found = [], [], []
            for k, page in enumerate(b.column(b.num_columns - 1).to_pylist()):
                tables = [t for t in parse_tables(page, container, row, cells_t, css_class, 1, plain) if len(t) >= min_data_rows]
                for no, t in enumerate(tables[:1] if first_only else tables):
                    rows.append(k)
                    numbers.append(no)
                    found.append(t)
            ids = [c.take(pa.array(rows, pa.int32())) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(numbers, pa.int32()), pa.array(found, table_type)],
                                             names=[*id_cols, "table_no", "rows"])

    # Pages without the container tag cannot yield rows: drop them JVM-side
    # (a case-insensitive regex find) before anything crosses into Python.
    has_tag = F.col(quote(html_col)).rlike(f"(?i)<{container}[\\s>/]")
    ids = [F.col(quote(c)) for c in id_cols]
    tables = df.select(*ids, F.col(quote(html_col))).filter(has_tag).mapInArrow(scan, out_schema)
    return (tables.select(*ids, "table_no", F.posexplode("rows").alias("row_no", "cells"), F.col("rows")[0].alias("header")))


# Fixed value: CSS class of the schedules result table (SRC-7).
SCHEDULE_TABLE_CLASS = "DFGUILBX"


def bind_to_header_length(rows: DataFrame, id_cols: Sequence[str] = ("page_id", "table_no")) -> DataFrame:
    """SRC-7 binding: body rows with fewer cells than the header are dropped;
    each header text (blank ones included) takes the cell at its position,
    extra cells are ignored; duplicate header texts keep the last value."""
    id_cols = list(id_cols)
    body = rows.filter((F.col("row_no") > 0) & (F.size("cells") >= F.size("header")))
    vals = F.slice(F.col("cells"), 1, F.size("header"))
    return body.select(*id_cols, F.col("row_no").alias("row_index"),
                       F.map_from_arrays(F.col("header"), vals).alias("record"))


def schedule_tables(df: DataFrame, html_col: str = "html", id_cols: Sequence[str] = ("page_id",)) -> DataFrame:
    """SRC-7 end to end: the first table of the schedules class, bound to
    its header row (the source's intent; its own code never returns rows)."""
    rows = html_rows(df, html_col, id_cols, css_class=SCHEDULE_TABLE_CLASS, min_data_rows=1)
    return bind_to_header_length(rows, list(id_cols) + ["table_no"])


def bind_header(rows: DataFrame, id_cols: Sequence[str] = ("page_id", "table_no"),
                drop_blank_rows: bool = False) -> DataFrame:
    """PRJ-5c: bind body rows (row_no > 0) to their table's header: the key
    is the header text, or ``column_j`` when it is blank or missing.
    Duplicate headers: the last value wins (``mapKeyDedupPolicy=LAST_WIN``).
    ``row_index`` (WIN-1) is the 1-based position among rows with cells.

    FLT-12: the source keeps every row (its "any value" test also sees the
    row index); ``drop_blank_rows=True`` drops rows whose cells are all ''.
    A projection: no join, no shuffle.
    """
    id_cols = list(id_cols)
    body = rows.filter(F.col("row_no") > 0)
    if drop_blank_rows:
        body = body.filter(F.exists("cells", lambda x: x != ""))
    keys = F.transform(
        F.sequence(F.lit(0), F.size("cells") - 1),
        lambda i: F.coalesce(F.nullif(F.get(F.col("header"), i), F.lit("")),
                             F.concat(F.lit("column_"), i.cast("string"))),
    )
    return body.select(*id_cols, F.col("row_no").alias("row_index"),
                       F.map_from_arrays(keys, F.col("cells")).alias("record"),
                       "cells")


def _ship_by_value() -> None:
    # The scan runs in Python workers, which may not have this package on
    # their path (a driver-only install, a notebook, a submitted script):
    # serialize this module's code with the task instead of by reference.
    # The module depends only on the standard library, pyarrow and pyspark.
    import sys as _sys

    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])


_ship_by_value()
