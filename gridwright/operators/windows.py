"""Ordered-position computations (WIN-1..WIN-6).

Spark runs a window without ``partitionBy`` in a single task. The global
running sum and the global row number here are therefore built in two
levels: rows are cut into ranges of equal depth, a window runs per range, and a
prefix over the (few) range totals is joined back. The totals table has at most
``MAX_BUCKETS`` rows per group, which is the bound that makes its broadcast safe.
"""

from __future__ import annotations

import re
import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions._util import quote

MAX_BUCKETS = 100_000


def stored_ranges(df: DataFrame, keys: Sequence[Column], num_partitions: int | None = None,
                  by_folder: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """``df`` range-partitioned by ``keys`` and stored once, with the range
    (``_gi_pid``) and the place in it (``_gi_pos``) of every row, and the stored
    names of its columns. Range bounds are quantiles of a sample of the keys, so
    ranges hold about the same number of rows however the keys are spread; the
    bounds are sampled per plan, which is why counts and results read one copy.
    ``by_folder`` stores each range in its own folder."""
    from ..session import scratch_path
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    names = {c: f"_gi_{i}" for i, c in enumerate(df.columns)}  # any column name can be stored
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .select(*[F.col(quote(c)).alias(v) for c, v in names.items()],
                      F.shiftright(at, 33).alias("_gi_pid"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_gi_pos")))
    path = scratch_path(spark, f"ranged-{uuid.uuid4().hex}")
    ranged.write.partitionBy(*["_gi_pid"] * by_folder).parquet(path)
    return spark.read.schema(ranged.schema).parquet(path), names


def running_sum(df: DataFrame, value: str, order: str, out: str = "cum",
                exclusive: bool = True, partition: Sequence[str] = (),
                bucket_size: int = 1, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Running sum of ``value`` in ``order`` (a key that is unique within
    ``partition``). ``exclusive`` sums strictly earlier rows (0 for the first).

    Two levels: a window per ``(partition, bucket)`` and a prefix over the
    bucket totals. Buckets are ranges of equal depth (quantiles of a sample of
    the keys): a dense range of keys is cut as often as its rows ask for. There
    are as many as shuffle partitions, at most ``max_buckets``, which bounds the
    offsets table per group; ``bucket_size`` is the least number of keys that a
    bucket may span. The table is broadcast only when there is no partition
    column, otherwise AQE decides."""
    part, b = list(partition), "_gi_pid"
    n = min(max_buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = F.col(quote(order))
    if bucket_size > 1:
        whole = F.floor(whole / bucket_size)
    stored, names = stored_ranges(df, [*[F.col(quote(c)) for c in part], whole], n)
    own, val, at = [names[c] for c in part], names[value], names[order]
    w_in = W.partitionBy(*own, b).orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = stored.withColumn("_rs_in", F.sum(val).over(w_in))
    totals = stored.groupBy(*own, b).agg(F.sum(val).alias("_rs_tot"))
    w_tot = W.partitionBy(*own).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*own, b, F.coalesce(F.sum("_rs_tot").over(w_tot), F.lit(0)).alias("_rs_off"))
    # groups match with NULL equal to NULL
    same = inside[b] == offsets[b]
    for c in own:
        same = same & inside[c].eqNullSafe(offsets[c])
    d = inside.join(offsets if part else F.broadcast(offsets), same).select(*[inside[c] for c in [*names.values(), "_rs_in"]], "_rs_off")
    incl = F.col("_rs_off") + F.col("_rs_in")
    res = incl - F.col(val) if exclusive else incl
    return d.select(*[F.col(v).alias(c) for c, v in names.items()], res.alias(out))


def tie_break(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """``order`` and behind it the other columns that have an order: a hot
    value of the order key is split across ranges."""
    rest = [f.name for f in df.schema.fields if f.name not in order and not re.search("map|variant", f.dataType.simpleString())]
    return [F.col(quote(c)) for c in [*order, *rest]]


def positions(stored: DataFrame, out: str) -> DataFrame:
    """0-based positions of stored ranged rows (``_gi_pid``, the range, and
    ``_gi_pos``, the place in it) in ``out``: the counts of all earlier ranges,
    a table with one row per range, are added."""
    counts = stored.groupBy("_gi_pid").agg(F.count(F.lit(1)).alias("_gi_n"))
    offs = counts.select("_gi_pid", F.coalesce(F.sum("_gi_n").over(
        W.orderBy("_gi_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_gi_off"))
    return stored.join(F.broadcast(offs), "_gi_pid").withColumn(
        out, (F.col("_gi_off") + F.col("_gi_pos")).cast("bigint")).drop("_gi_pid", "_gi_pos", "_gi_off")


def global_index(df: DataFrame, order: Sequence[str], out: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """A 0-based position of every row in ``order`` (ties broken by the
    other columns that have an order), without a single-task window: range-partition by the
    order, sort inside partitions, take the position inside the partition from
    ``monotonically_increasing_id`` and add the count of all earlier
    partitions (a table with one row per partition).

    The ranged rows are stored once (``stored_ranges``); both the counts and
    the result read that copy."""
    stored, names = stored_ranges(df, tie_break(df, list(order)), num_partitions)
    return positions(stored, "_gi_idx").select(*[F.col(v).alias(c) for c, v in names.items()], F.col("_gi_idx").alias(out))


def raw_position(df: DataFrame, out: str = "row_index", row_col: str = "row_no") -> DataFrame:
    """WIN-1: 1-based position in the raw page, taken from the landing row
    number before any filter, so dropped rows leave gaps."""
    return df.withColumn(out, (F.col(row_col) + 1).cast("bigint"))


def progress(df: DataFrame, n: str, order: str, total: Column | str,
             out: str = "progress_pct", partition: Sequence[str] = ()) -> DataFrame:
    """WIN-2: progress before each batch, ``min(int(cum / total * 100), 99)``
    with ``cum`` = rows before the batch; dividing first, in double, as the
    source does. NULL when the total is 0 or NULL."""
    d = running_sum(df, n, order, out="rows_before", exclusive=True, partition=partition)
    # bind the total once (it may be a scalar subquery), then refer to the column
    d = d.withColumn("_pg_total", F.col(total) if isinstance(total, str) else total)
    t = F.col("_pg_total")
    pct = F.floor((F.col("rows_before").cast("double") / t.cast("double")) * F.lit(100.0))
    return d.withColumn(out, F.when(t.isNull() | (t == 0), F.lit(None))
                        .otherwise(F.least(pct.cast("bigint"), F.lit(99).cast("bigint")))).drop("_pg_total")


def previous_page(pages: DataFrame, cols: Sequence[str], partition: Sequence[str] = ("capture_id",),
                  page: str = "page_no") -> DataFrame:
    """WIN-3 helper: attach ``prev_<col>`` of the previous page (page_no - 1)
    by an equi-join on consecutive page numbers: ``lag`` without a window, so
    pages of one capture need not meet in one task."""
    part = list(partition)
    prev = pages.select(*part, (F.col(page) + 1).alias(page),
                        *[F.col(quote(c)).alias(f"prev_{c}") for c in cols])
    return pages.join(prev, part + [page], "left")


def stalled_pages(pages: DataFrame, length: str = "n_rows", first_key: str = "first_key",
                  partition: Sequence[str] = ("capture_id",), page: str = "page_no") -> DataFrame:
    """WIN-3: a page *changed* when its length or first key differs from the
    previous page (NULL-safe); the first page has nothing to compare with."""
    j = previous_page(pages, [length, first_key], partition, page)
    has_prev = F.col(f"prev_{length}").isNotNull()
    changed = ~(F.col(length).eqNullSafe(F.col(f"prev_{length}"))
                & F.col(first_key).eqNullSafe(F.col(f"prev_{first_key}")))
    return j.withColumn("changed", F.when(has_prev, changed))


def batch_positions(df: DataFrame, order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """WIN-4: 0-based batch index, batch total and ``int(i / total * 100)``.

    Batches are runs of a request (a handful per export), so a window per
    ``partition`` is bounded by the number of batches, not by data.
    """
    part = list(partition)
    w = W.partitionBy(*part).orderBy(*[quote(c) for c in order])
    d = (df.withColumn("batch_index", (F.row_number().over(w) - 1).cast("bigint"))
         .withColumn("batch_total", F.count(F.lit(1)).over(W.partitionBy(*part)).cast("bigint")))
    return d.withColumn("batch_progress", F.floor(
        F.col("batch_index").cast("double") / F.col("batch_total").cast("double") * 100.0).cast("bigint"))


def stop_page(page_stats: DataFrame, page_size: int = 1000, partition: Sequence[str] = ("capture_id",),
              page: str = "page_no") -> DataFrame:
    """WIN-5: the first page that ends a read, per capture: an empty page, a
    page with no new keys, or a short page (< ``page_size`` valid rows).
    Input has ``n_valid`` and ``n_new`` per page. Output ``(partition...,
    stop_page)``; NULL when no page stops the read. Pages after an empty or
    all-duplicate page are not read; a short page is itself read."""
    part = list(partition)
    p = F.col(page)
    ends_before = (F.col("n_valid") == 0) | (F.col("n_new") == 0)
    ends_after = F.col("n_valid") < page_size
    return page_stats.groupBy(*part).agg(
        F.min(F.when(ends_before, p - 1).when(ends_after, p)).alias("stop_page"))


def _stop_filter(rows: DataFrame, stop, page: str) -> DataFrame:
    # one reference to the stop value (it may be a scalar subquery)
    return rows.filter(F.coalesce(F.col(page) <= stop, F.lit(True)))


def honor_stop_rules(rows: DataFrame, page_stats: DataFrame, page_size: int = 1000,
                     partition: Sequence[str] = ("capture_id",), page: str = "page_no") -> DataFrame:
    """WIN-5 (opt-in): keep only rows of pages read before the stop. The
    per-capture stop table has one row per capture."""
    stops = stop_page(page_stats, page_size, partition, page)
    if not partition:
        # one read: the stop page is a scalar subquery, no join
        return _stop_filter(rows, stops.select("stop_page").scalar(), page)
    j = rows.join(stops, list(partition), "left")
    return _stop_filter(j, F.col("stop_page"), page).drop("stop_page")


def continuation_key(rows: DataFrame, key: str, partition: Sequence[str] = ("capture_id", "page_no"),
                     order: str = "row_no") -> DataFrame:
    """WIN-6: first and last key of a page's new rows (partial aggregate)."""
    return rows.groupBy(*partition).agg(
        F.min_by(quote(key), order).alias("first_key"),
        F.max_by(quote(key), order).alias("last_key"),
        F.count(F.lit(1)).alias("n_new"))
