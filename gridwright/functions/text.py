"""Text cleaning and naming functions (FN-1, FN-2, FN-2b, FN-5, FN-12, FN-13,
FN-17). Every function maps ``Column -> Column`` and stays JVM-side."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

# The markup tokens the source system pads cells with, and the
# sequence that one of its grids uses between words.
NBSP_ENTITY = "&nbsp;"
NBSP_BARE = "&nbsp"
SPACE_SEMICOLON = " ;"


def _python_whitespace() -> str:
    """Every code point whose ``str.isspace()`` is true, built from the rule,
    so the strip below removes exactly what ``str.strip()`` removes (Spark's
    one-argument ``trim`` removes only the ASCII space)."""
    return "".join(chr(cp) for cp in range(sys.maxunicode + 1) if chr(cp).isspace())


_WS_CHARS = _python_whitespace()


def py_strip(c) -> Column:
    """Python ``str.strip()`` with no argument: ``btrim`` with the full
    Unicode white-space set (a character-set trim, no regex)."""
    return F.btrim(as_col(c), F.lit(_WS_CHARS))


def clean_cell(c) -> Column:
    """FN-1: ``&nbsp;`` then ``&nbsp`` become a space, then strip (order matters)."""
    c = as_col(c)
    return py_strip(F.replace(F.replace(c, F.lit(NBSP_ENTITY), F.lit(" ")),
                              F.lit(NBSP_BARE), F.lit(" ")))


def clean_cell_semicolon(c) -> Column:
    """FN-2: FN-1 plus `` ;`` to a space, before the strip."""
    c = as_col(c)
    c = F.replace(F.replace(c, F.lit(NBSP_ENTITY), F.lit(" ")), F.lit(NBSP_BARE), F.lit(" "))
    return py_strip(F.replace(c, F.lit(SPACE_SEMICOLON), F.lit(" ")))


def clean_entity_only(c) -> Column:
    """FN-2b: only ``&nbsp;`` becomes a space, then strip."""
    return py_strip(F.replace(as_col(c), F.lit(NBSP_ENTITY), F.lit(" ")))


def blank_if_markup(c) -> Column:
    """FN-5: '' when the stripped text is empty or only an nbsp token,
    else FN-2 cleaned text. NULL input is treated as ''."""
    c = F.coalesce(as_col(c), F.lit(""))
    s = py_strip(c)
    return F.when(s.isin(NBSP_ENTITY, NBSP_BARE, ""), F.lit("")).otherwise(clean_cell_semicolon(c))


def snake_case(c) -> Column:
    """FN-12: lower case, spaces to underscores."""
    return F.lower(F.replace(as_col(c), F.lit(" "), F.lit("_")))


def snake_name(name: str) -> str:
    """FN-12 for column names on the driver."""
    return name.lower().replace(" ", "_")


def title_label(c) -> Column:
    """FN-13: underscores to spaces, then Python ``str.title``: a cased letter
    is upper when the character before it is not a letter, else lower.
    (Spark ``initcap`` capitalises only after white space.)"""
    s = F.replace(as_col(c), F.lit("_"), F.lit(" "))
    chars = F.split(s, "", -1)
    return F.when(s == "", s).otherwise(F.array_join(
        F.transform(chars, lambda ch, i: F.when(
            (i == 0) | ~F.get(chars, i - 1).rlike("^\\p{L}$"), F.upper(ch)
        ).otherwise(F.lower(ch))),
        "",
    ))


def join_list(c, sep: str = ", ") -> Column:
    """FN-17 / PRJ-11: ``', '.join(str(x) for x in list)``; NULL items print
    as ``None`` as ``str(None)`` does."""
    arr = as_col(c)
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), sep, "None")
