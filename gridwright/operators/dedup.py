"""Keep-first dedup and set operations (SET-1..SET-9).

Keep-first is an aggregate, not a window: ``min(struct(order..., rest...))``
per key. The aggregate runs partial (map side) then final, so a key that
holds a third of all rows leaves each map task as one row; the shuffle never
carries more than ``#keys x #map tasks`` rows and no task sees a whole hot
group. ``dropDuplicates`` is not used because it does not promise which row
survives.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions._util import quote

ARRIVAL_ORDER = ("page_no", "row_no")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ARRIVAL_ORDER,
               drop_empty_keys: bool = True) -> DataFrame:
    """SET-1 / SET-2: one row per key, the first in ``order``.

    Rows whose key is NULL or '' are dropped (the source skips falsy keys).
    Ties on ``order`` are broken by the remaining columns that have an order,
    so the result is deterministic. Column order of ``df`` is kept.
    """
    keys = list(keys)
    order = [c for c in order if c in df.columns]
    if drop_empty_keys:
        for k in keys:
            kc = F.col(quote(k))
            df = df.filter(kc.isNotNull() & (kc.cast("string") != ""))
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(quote(c)).alias(f"_{i}") for i, c in enumerate(order + rest)])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    sortable = [c for c in order + rest if not re.search("map|variant", kinds[c])]
    if len(sortable) == len(order + rest):
        first = F.min(packed)
    else:  # a MAP or VARIANT has no order: it travels beside the key that is compared
        first = F.min_by(packed, F.struct(*[F.col(quote(c)) for c in sortable]) if sortable else F.lit(0))
    agg = df.groupBy(*[F.col(quote(k)) for k in keys]).agg(first.alias("_first"))
    names = order + rest
    sel = {k: F.col(quote(k)) for k in keys}
    for i, c in enumerate(names):
        sel[c] = F.col(f"_first._{i}").alias(c)
    return agg.select(*[sel[c] for c in df.columns])


def union_by_name(dfs: Iterable[DataFrame]) -> DataFrame:
    """SET-3 / SET-9: union all by column name, missing columns NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), list(dfs))


def tag_dataset(df: DataFrame, dataset: str, column: str = "data_type") -> DataFrame:
    """PRJ-12: dataset tag as the first column. A record's own value of the
    tag column wins (dict merge order of the source)."""
    if column in df.columns:
        tag = F.coalesce(F.col(column), F.lit(dataset)).alias(column)
        return df.select(tag, *[F.col(quote(c)) for c in df.columns if c != column])
    return df.select(F.lit(dataset).alias(column), *[F.col(quote(c)) for c in df.columns])


def combine_datasets(frames: dict, column: str = "data_type", selected: Sequence[str] | None = None) -> DataFrame:
    """SET-3 + PRJ-12 + SET-4: tagged union of several datasets (selection
    order kept; unknown or absent names skipped)."""
    names = [n for n in (selected or list(frames)) if n in frames]
    kinds: dict[str, set] = {}
    for n in names:
        for f in frames[n].schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    clash = {c for c, k in kinds.items() if len(k) > 1}  # a column that differs in type is text, as the source writes it
    return union_by_name(tag_dataset(frames[n].select(*[
        F.col(quote(c)).cast("string").alias(c) if c in clash else F.col(quote(c)) for c in frames[n].columns]), n, column)
        for n in names)


def intersect_sorted(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-5: distinct rows present in both, sorted."""
    out = a.intersect(b)
    return out.orderBy(*out.columns)


def difference(requested: DataFrame, allowed: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """SET-6 / JON-3: requested rows with no match in allowed (anti join)."""
    on = list(on or requested.columns)
    return requested.join(allowed.select(*on).distinct(), on, "left_anti")


def ordered_distinct(df: DataFrame, value: str, seq: str) -> DataFrame:
    """SET-7: distinct values in first-seen order: ``(value, first_seq)``
    sorted by ``first_seq`` (partial aggregate, one row per value)."""
    return (df.groupBy(value).agg(F.min(seq).alias("first_seq"))
            .orderBy("first_seq", value))


def sorted_column_union(dfs: Iterable[DataFrame]) -> list[str]:
    """SET-8: sorted union of column names (schema only, no job)."""
    names: set[str] = set()
    for d in dfs:
        names.update(d.columns)
    return sorted(names)
