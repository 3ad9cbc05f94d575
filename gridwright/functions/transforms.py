"""Named field transforms of an export schema (FN-7..FN-11, UDF-1).

A transform is a ``Column -> Column`` function registered under a name. The
schema projection applies it only to non-NULL values; an unknown name leaves
the value unchanged.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import to_float_or_zero, to_int_or_zero_text, to_int_or_zero
from .text import py_strip

Transform = Callable[[Column], Column]

_REGISTRY: dict[str, Callable[[Column, str], Column]] = {}


def register_transform(name: str, fn: Callable[..., Column]) -> None:
    """UDF-1: add a named transform. ``fn(col)`` or ``fn(col, spark_type)``."""
    import inspect

    if len(inspect.signature(fn).parameters) == 1:
        _REGISTRY[name] = lambda c, t, _f=fn: _f(c)
    else:
        _REGISTRY[name] = fn


def _text_case(op):
    def apply(c: Column, dtype: str) -> Column:
        if dtype == "string":
            return op(c)  # '' stays '' (falsy value unchanged)
        # str(v).upper() for truthy non-text values; falsy values unchanged
        # cannot share a column type with text, so the result is text.
        return op(c.cast("string"))
    return apply


def _strip(c: Column, dtype: str) -> Column:
    return py_strip(c if dtype == "string" else c.cast("string"))


def _int(c: Column, dtype: str) -> Column:
    if dtype == "string":
        return to_int_or_zero_text(c)
    if dtype == "boolean":
        return c.cast("bigint")
    return to_int_or_zero(c)


def _float(c: Column, dtype: str) -> Column:
    if dtype == "string":
        return F.coalesce(py_strip(c).try_cast("double"), F.lit(0.0))
    return to_float_or_zero(c)


register_transform("upper", _text_case(F.upper))
register_transform("lower", _text_case(F.lower))
register_transform("strip", _strip)
register_transform("int", _int)
register_transform("float", _float)


def known_transforms() -> list[str]:
    return sorted(_REGISTRY)


def apply_transform(c: Column, name: str | None, dtype: str = "string") -> Column:
    """FN-10: apply the named transform to non-NULL values; unknown or empty
    names leave the value as it is; NULL skips any transform."""
    if not name or name not in _REGISTRY:
        return c
    return F.when(c.isNull(), F.lit(None)).otherwise(_REGISTRY[name](c, dtype))
