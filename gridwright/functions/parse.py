"""Parsing functions: names, federal ids, numbers, reported totals
(FN-3, FN-4, FN-6, FN-8, FN-9, FN-14, SRC-8/9 value rule)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col
from .text import py_strip

# Fixed value: a federal id starts with a two-letter state code followed by
# digits; trailing text is ignored (prefix match).
FEDERAL_ID_PATTERN = r"^([A-Z]{2})([0-9]+)"


def split_name(c) -> Column:
    """FN-3: split on the first comma into ``struct(last, first)``, both
    stripped; without a comma the whole text is the last name, first is ''."""
    c = as_col(c)
    parts = F.split(c, ",", 2)
    has_comma = F.size(parts) > 1
    last = py_strip(F.get(parts, 0))
    first = F.when(has_comma, py_strip(F.get(parts, 1))).otherwise(F.lit(""))
    return F.struct(last.alias("last"), first.alias("first"))


def join_name(last, first) -> Column:
    """FN-4: ``"LAST, FIRST"``, or ``LAST`` when first is empty."""
    last, first = as_col(last), as_col(first)
    return F.when(first != "", F.concat(last, F.lit(", "), first)).otherwise(last)


def federal_id(c) -> Column:
    """FN-6: ``struct(state STRING, number BIGINT)``; ('' , 0) when the text
    does not start with two capitals and digits. Digits beyond BIGINT give 0;
    ``rules.fits_bigint`` reports them and ``exact_integer`` keeps them."""
    c = F.coalesce(as_col(c), F.lit(""))
    state = F.regexp_extract(c, FEDERAL_ID_PATTERN, 1)
    digits = F.regexp_extract(c, FEDERAL_ID_PATTERN, 2)
    number = F.when(state != "", F.coalesce(digits.try_cast("bigint"), F.lit(0))).otherwise(F.lit(0).cast("bigint"))
    return F.struct(state.alias("state"), number.cast("bigint").alias("number"))


def to_int_or_zero(c) -> Column:
    """FN-8 (`int` transform): falsy or unparsable → 0; text is stripped as
    Python ``int()`` does; ``'12.5'`` → 0; doubles truncate toward zero."""
    c = as_col(c)
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


def to_int_or_zero_text(c) -> Column:
    """FN-8 for text columns: strip with Python rules first, then parse."""
    return F.coalesce(py_strip(as_col(c)).try_cast("bigint"), F.lit(0).cast("bigint"))


def to_float_or_zero(c) -> Column:
    """FN-9 (`float` transform): falsy or unparsable → 0.0; accepts nan,
    inf and exponents."""
    c = as_col(c)
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def digits_or_null(c) -> Column:
    """FN-14 / SRC-8: stripped text of ASCII digits only → BIGINT, else NULL."""
    s = py_strip(as_col(c))
    return F.when(s.rlike("^[0-9]+$"), s.try_cast("bigint"))


def exact_integer(c) -> Column:
    """Stripped text of a sign and ASCII digits → DECIMAL(38,0), which holds
    numbers past BIGINT; other text and more than 38 digits → NULL."""
    s = py_strip(as_col(c))
    return F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("decimal(38,0)"))
