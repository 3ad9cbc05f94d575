"""Formatting, classification and version functions (FN-15, FN-16, FN-19,
FN-20, FN-21, FN-22, FN-23, FN-24)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col


def duration_text(c, style: str = "short") -> Column:
    """FN-15: ``'%.2fs'`` (short) or ``'%.2f seconds'`` (long)."""
    pattern = "%.2fs" if style == "short" else "%.2f seconds"
    return F.format_string(pattern, as_col(c).cast("double"))


def iso_timestamp(c) -> Column:
    """FN-16: Python ``datetime.isoformat()``: the fraction is printed only
    when the microseconds are non-zero."""
    c = as_col(c)
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(frac)


def stamp(c, pattern: str = "yyyyMMdd_HHmmss") -> Column:
    """FN-16: file-name stamp (``%Y%m%d_%H%M%S``)."""
    return F.date_format(as_col(c), pattern)


# Error categories of the extraction error translation, in
# precedence order (first substring found wins; the match ignores case).
EXTRACTION_ERROR_CLASSES = (
    ("authentication", "authentication_error"),
    ("session", "session_error"),
    ("pagination", "pagination_error"),
)
EXTRACTION_ERROR_DEFAULT = "extraction_error"


def classify_extraction_error(message) -> Column:
    """FN-19: category of an extraction failure message."""
    m = F.lower(F.coalesce(as_col(message), F.lit("")))
    out = None
    for needle, label in EXTRACTION_ERROR_CLASSES:
        cond = m.contains(needle)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(EXTRACTION_ERROR_DEFAULT))


# Output error categories.
OS_ERROR_TYPES = ("OSError", "PermissionError", "FileNotFoundError", "IsADirectoryError",
                  "NotADirectoryError", "FileExistsError")


def classify_output_error(error_type, message) -> Column:
    """FN-20: ValueError whose text mentions "format" → invalid_format;
    operating-system errors → write_failure; anything else → export_failure."""
    t, m = as_col(error_type), F.lower(F.coalesce(as_col(message), F.lit("")))
    return (F.when((t == "ValueError") & m.contains("format"), F.lit("invalid_format"))
            .when(t.isin(*OS_ERROR_TYPES), F.lit("write_failure"))
            .otherwise(F.lit("export_failure")))


def version_compatible(version, other, breaking) -> Column:
    """FN-21: when the version carries breaking changes and both are dotted,
    compatible iff the major numbers are equal; otherwise compatible."""
    v, o, b = as_col(version), as_col(other), as_col(breaking)
    both_dotted = v.contains(".") & o.contains(".")
    same_major = (F.split_part(v, F.lit("."), F.lit(1)).try_cast("bigint")
                  == F.split_part(o, F.lit("."), F.lit(1)).try_cast("bigint"))
    return F.when(F.coalesce(b, F.lit(False)) & both_dotted, F.coalesce(same_major, F.lit(False))).otherwise(F.lit(True))


def version_sort_key(version) -> Column:
    """SRT-7 helper: numeric order of a dotted version (``1.10.0`` > ``1.9.0``)."""
    return F.transform(F.split(as_col(version), "\\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(-1).cast("bigint")))


def row_json(*cols) -> Column:
    """FN-22: serialize a row with NULL fields kept (``ignoreNullFields=false``)."""
    s = F.struct(*[as_col(c) for c in cols]) if cols else F.struct("*")
    return F.to_json(s, {"ignoreNullFields": "false"})


def merge_maps(*maps) -> Column:
    """FN-23: ``{**a, **b}``: later maps win (needs ``mapKeyDedupPolicy=LAST_WIN``)."""
    return F.map_concat(*[as_col(m) for m in maps])


def clamp_percent(c) -> Column:
    """FN-24: clamp to 0..100."""
    return F.least(F.greatest(as_col(c), F.lit(0)), F.lit(100))
