from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Accept a Column or a column name (names may hold spaces and dots)."""
    if isinstance(c, Column):
        return c
    return F.col(quote(c))


def quote(name: str) -> str:
    """Back-tick a column name so dots and spaces are taken literally."""
    if name.startswith("`") and name.endswith("`"):
        return name
    return "`" + name.replace("`", "``") + "`"


def once(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the columns ``names`` worked out once a row, behind the
    others. Projections and filters are merged into the ones below them, so a
    costly column (a parsed JSON text) would be worked out again wherever it is
    looked at; they do not pass a generated row."""
    rest = [F.col(quote(c)) for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*[F.col(quote(c)).alias(c) for c in names]))))
