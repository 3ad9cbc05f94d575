"""Row filters (FLT-5..FLT-12) and lookups (JON-1..JON-4).

Every filter is a predicate over the rows in place: Catalyst pushes the
comparison filters into the Parquet scan (see ``PushedFilters``); regex
filters run in the scan stage, before any shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions._util import as_col, quote


ACTIVE_STATUS = "A"  # fixed value: status code of active rows


@dataclass(frozen=True)
class PatternCheck:
    index: int
    pattern: str
    valid: bool
    error: str | None


def _java_error(spark: SparkSession, p: str) -> str | None:
    """What the engine's own regex compiler says about ``p``; no job runs."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(p)
    except Exception as e:  # Java rejects the pattern
        cause = getattr(e, "java_exception", None)
        return f"invalid regex pattern: {cause.getMessage() if cause is not None else e}"
    return None


def check_patterns(spark: SparkSession, patterns: Sequence[str]) -> list[PatternCheck]:
    """FLT-6: a pattern is usable when both Python ``re`` (the source's
    dialect) and Java regex (the engine's) accept it; Python-only syntax such
    as ``(?P<n>...)`` is rejected. Both only compile the text: no job runs."""
    out = []
    for i, p in enumerate(patterns):
        err = None
        if not isinstance(p, str):
            err = "pattern must be text"
        else:
            try:
                re.compile(p)
            except re.error as e:
                err = f"invalid regex pattern: {e}"
            if err is None:
                err = _java_error(spark, p)
        out.append(PatternCheck(i, p, err is None, err))
    return out


def matches_any(c, patterns: Sequence[str]) -> Column:
    """True when any pattern is *found* in the text (search, not full match);
    NULL text counts as no match."""
    c = as_col(c)
    if not patterns:
        return F.lit(False)
    return F.coalesce(reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns]), F.lit(False))


def exclude_patterns(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """FLT-5: drop rows whose ``column`` contains a match of any pattern; no
    patterns → unchanged. Rows with NULL text are kept."""
    if not patterns:
        return df
    return df.filter(~matches_any(column, patterns))


def any_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """FLT-4: keep rows where at least one of ``columns`` is non-empty."""
    cond = reduce(lambda a, b: a | b,
                  [F.coalesce(F.col(quote(c)).cast("string"), F.lit("")) != "" for c in columns])
    return df.filter(cond)


def search(df: DataFrame, params: Mapping[str, Any], field_map: Mapping[str, str] | None = None) -> DataFrame:
    """FLT-7: equality search. A parameter name is translated through
    ``field_map`` (falling back to itself, JON-1); parameters that address no
    column, or whose value is None, are skipped. ``active_only`` is a flag: True
    asks for active rows, False for all. A value is compared in the column's
    own type; one that has no such value matches nothing."""
    field_map = dict(field_map or {})
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    conds = []
    for k, v in params.items():
        col = field_map.get(k, k)
        if k == "active_only" and isinstance(v, bool):
            v = ACTIVE_STATUS if v else None
        if col not in df.columns or v is None:
            continue
        conds.append(F.coalesce(F.col(quote(col)) == F.lit(str(v)).try_cast(types[col]), F.lit(False)))
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """FLT-9: inclusive range filter; an open end is not applied."""
    c = F.col(quote(column))
    if low is not None:
        df = df.filter(c >= F.lit(low))
    if high is not None:
        df = df.filter(c <= F.lit(high))
    return df


def split_outcomes(df: DataFrame, flag: str = "success") -> tuple[DataFrame, DataFrame]:
    """FLT-11: (successful, failed)."""
    f = F.coalesce(F.col(flag), F.lit(False))
    return df.filter(f), df.filter(~f)


def lookup_or_self(df: DataFrame, column: str, mapping: Mapping[str, str], out: str | None = None) -> DataFrame:
    """JON-1 with a configuration-sized dict: ``mapping.get(v, v)`` as a map
    literal (no join at all)."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]) \
        if mapping else F.create_map().cast("map<string,string>")
    c = F.col(quote(column))
    return df.withColumn(out or column, F.coalesce(F.try_element_at(m, c), c))


def lookup_join(df: DataFrame, column: str, table: DataFrame, key: str, value: str,
                out: str | None = None, salt_buckets: int = 0) -> DataFrame:
    """JON-1 with a lookup table: left join + ``coalesce(value, self)``.

    The table is deduplicated on its key first (last write wins is not
    defined for tables, so the smallest value wins). One shuffle join is
    planned; Spark turns it into a broadcast when the measured bytes allow it
    and splits skewed partitions. ``salt_buckets > 1`` salts explicitly: each
    probe row gets a random bucket and the lookup rows are replicated once per
    bucket, so a key holding a third of the rows is spread over
    ``salt_buckets`` tasks.
    """
    out = out or column
    t = table.groupBy(key).agg(F.min(value).alias("_lk_value"))
    if salt_buckets > 1:
        probe = df.withColumn("_lk_salt", (F.rand() * salt_buckets).cast("int"))
        build = t.withColumn("_lk_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
        j = probe.join(build, (probe[quote(column)] == build[key]) & (probe["_lk_salt"] == build["_lk_salt"]), "left")
        return j.select(*[probe[quote(x)] for x in df.columns if x != out],
                        F.coalesce(F.col("_lk_value"), probe[quote(column)]).alias(out))
    j = df.join(t, df[quote(column)] == t[key], "left")
    return j.select(*[df[quote(x)] for x in df.columns if x != out],
                    F.coalesce(F.col("_lk_value"), df[quote(column)]).alias(out))


def semi(df: DataFrame, allowed, on: Sequence[str]) -> DataFrame:
    """JON-2: rows whose key is in the allowed set. A configuration list is
    an ``isin`` filter (no join); a table is a left-semi join."""
    if isinstance(allowed, (list, tuple, set, frozenset)):
        (c,) = on
        return df.filter(F.col(quote(c)).isin(*sorted(allowed)))
    return df.join(allowed.select(*on).distinct(), list(on), "left_semi")


def anti(df: DataFrame, allowed, on: Sequence[str]) -> DataFrame:
    """JON-3: rows whose key is not in the allowed set (offending values).
    With a list, NULL keys are kept, as a left-anti join keeps them."""
    if isinstance(allowed, (list, tuple, set, frozenset)):
        (c,) = on
        return df.filter(F.coalesce(~F.col(quote(c)).isin(*sorted(allowed)), F.lit(True)))
    return df.join(allowed.select(*on).distinct(), list(on), "left_anti")


def zip_by_position(a: DataFrame, b: DataFrame, index: str = "batch_index") -> DataFrame:
    """JON-4: pair two sequences 1:1 by their position column."""
    return a.join(b, index, "inner")
