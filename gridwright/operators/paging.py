"""Sort, limit, top-k and paging (SRT-1..SRT-7)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions._util import quote
from ..functions.fmt import version_sort_key
from .windows import global_index, stored_ranges, tie_break


def preview(df: DataFrame, n: int = 2, partition: Sequence[str] = ("data_type",),
            order: Sequence[str] = ()) -> DataFrame:
    """SRT-1: first ``n`` rows per dataset. ``row_number() <= n`` is planned
    as a partial + final ``WindowGroupLimit``: each map task sends at most
    ``n`` rows per group."""
    order = list(order) or [c for c in df.columns if c not in partition]
    w = W.partitionBy(*partition).orderBy(*[quote(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


#: A window that ends within so many rows is a distributed top-k, a deeper one is found by a ``PageIndex``.
TOP_ROWS = 10_000


class PageIndex:
    """Any window of rows of a table in ``order`` (ties broken by the other
    columns that have an order). The rows are stored once in ranges, a folder
    each; a small table counts the rows of every range. A window opens only
    the folders that hold a part of it."""

    def __init__(self, df: DataFrame, order: Sequence[str], num_partitions: int | None = None):
        self.stored, self.names = stored_ranges(df, tie_break(df, list(order)), num_partitions, by_folder=True)
        counts = self.stored.groupBy("_gi_pid").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(W.orderBy("_gi_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        self.counts = counts.select("_gi_pid", "n", before.alias("first"))  # one row per range

    def rows(self, first: int, n: int | None = None, out: str = "_pos") -> DataFrame:
        """Rows ``first`` to ``first + n - 1`` (0-based; ``n=None``: all from
        ``first`` on) with their position."""
        end = F.lit(True) if n is None else F.col("first") < first + n
        held = self.counts.filter((F.col("first") + F.col("n") > first) & end).collect()  # numbers and offsets of the ranges of the window
        cols = [F.col(v).alias(c) for c, v in self.names.items()]
        if not held:
            return self.stored.filter(F.lit(False)).select(*cols, F.lit(0).cast("bigint").alias(out))
        start = F.create_map(*[F.lit(x) for r in held for x in (r["_gi_pid"], r["first"])])
        d = self.stored.filter(F.col("_gi_pid").isin([r["_gi_pid"] for r in held]))
        d = d.withColumn("_gi_idx", (F.element_at(start, F.col("_gi_pid")) + F.col("_gi_pos")).cast("bigint"))
        inside = F.col("_gi_idx") >= first
        if n is not None:
            inside = inside & (F.col("_gi_idx") < first + n)
        return d.filter(inside).select(*cols, F.col("_gi_idx").alias(out))


def offset_page(df: DataFrame, order: Sequence[str], page_size: int, start_page: int = 1,
                max_pages: int | None = 1, top_rows: int = TOP_ROWS, index: PageIndex | None = None) -> DataFrame:
    """SRT-2: pages ``start_page .. start_page + max_pages - 1`` (1-based) of
    ``page_size`` rows in ``order``, with ``page_no`` and ``row_in_page``;
    ``max_pages=None`` reads to the end.

    A window that ends within ``top_rows`` rows is a distributed top-k of that
    many rows at most; a deeper one opens the ranges of a ``PageIndex`` that
    hold it (``index``: one built before, for many pages of a table), and a read
    to the end uses the distributed global index. All give the same rows."""
    first = (start_page - 1) * page_size
    if index is None and max_pages is None:
        d = global_index(df, order, out="_pos").filter(F.col("_pos") >= first)
    elif index is not None or first + max_pages * page_size > top_rows:
        d = (index or PageIndex(df, order)).rows(first, None if max_pages is None else max_pages * page_size)
    else:
        keys = tie_break(df, list(order))
        d = df.orderBy(*keys).offset(first).limit(max_pages * page_size)
        d = d.withColumn("_pos", F.lit(first - 1) + F.row_number().over(W.orderBy(*keys)))
    return (d.withColumn("page_no", (F.floor(F.col("_pos") / page_size) + 1).cast("bigint"))
            .withColumn("row_in_page", (F.col("_pos") % page_size + 1).cast("bigint"))
            .drop("_pos"))


def keyset_page(df: DataFrame, key: str, after: str | None, page_size: int = 1000,
                inclusive: bool = True) -> DataFrame:
    """SRT-3: one keyset page: rows with ``key >= after`` (or ``>``) in key
    order, at most ``page_size`` (planned as a distributed top-k)."""
    k = F.col(quote(key))
    d = df if after is None else df.filter(k >= after if inclusive else k > after)
    return d.orderBy(k).limit(page_size)


def keyset_scan(df: DataFrame, key: str, page_size: int = 1000, inclusive: bool = True) -> DataFrame:
    """SRT-3 over the whole table, without one query per page: every row gets
    the number of the search that first returns it. With inclusive searches
    (``key >= last key of the previous page``, as the source reads) each
    search after the first repeats one row and brings ``page_size - 1`` new
    ones, so for unique keys the search of position ``p`` is ``0`` when
    ``p < page_size``, else ``(p - 1) div (page_size - 1)``; exclusive
    searches give ``p div page_size``."""
    d = global_index(df, [key], out="_pos")
    pos = F.col("_pos")
    if inclusive and page_size > 1:
        search = F.when(pos < page_size, F.lit(0)).otherwise(F.floor((pos - 1) / (page_size - 1)))
    else:
        search = F.floor(pos / page_size)
    return d.withColumn("search_no", search.cast("bigint")).drop("_pos")


def top_by(df: DataFrame, value: str, by: str, group: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """SRT-4 / SRC-5: per group the ``value`` with the highest numeric ``by``;
    ties go to the smallest ``tie`` columns (explicit, deterministic). A
    partial aggregate: one row per group leaves each map task."""
    if tie:
        ordering = F.struct((-F.col(quote(by))).alias("_b"), *[F.col(quote(t)) for t in tie])
        pick = F.min_by(quote(value), ordering)
    else:
        pick = F.max_by(quote(value), quote(by))
    return df.groupBy(*group).agg(pick.alias(value), F.max(quote(by)).alias(by))


def latest_version(versions: DataFrame, name: str = "schema_name", version: str = "version",
                   default: str | None = "default_version") -> DataFrame:
    """SRT-7: per schema, the default version when one is set, else the
    highest version in numeric dotted order (``1.10.0`` > ``1.9.0``)."""
    agg = [F.max_by(quote(version), version_sort_key(F.col(quote(version)))).alias("latest")]
    if default and default in versions.columns:
        agg.append(F.max(quote(default)).alias("_default"))
    out = versions.groupBy(name).agg(*agg)
    if default and default in versions.columns:
        out = out.select(name, F.coalesce("_default", "latest").alias("version"))
    else:
        out = out.select(name, F.col("latest").alias("version"))
    return out
