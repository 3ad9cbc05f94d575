"""Landed result-grid pages (SRC-1..SRC-5, SRC-8/9).

A captured page is the 2-D array a results grid keeps in the page script:
rows of cells, each cell an array whose item 0 is the text. Captures land as
JSON lines ``{"dataset", "capture_id", "page_no", "values": [[[..],..],..],
"total": "..."}``. The landing table has one row per grid row:

    dataset STRING, capture_id STRING, page_no BIGINT, row_no BIGINT,
    cells ARRAY<ARRAY<STRING>>   (strict form)
    row VARIANT                  (ragged form: scalar cells allowed)

``page_no, row_no`` give arrival order and are the only order "first" ever
refers to (keep-first dedup, stop rules).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions._util import once
from ..functions.parse import digits_or_null

LANDING_KEYS = ["dataset", "capture_id", "page_no", "row_no"]


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Read captured pages as one VARIANT per line (no schema inference).
    A line that is no JSON gives a NULL page, and so no rows: one bad line never
    ends a read. ``capture_issues`` lists such lines."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("page"))


def capture_issues(spark: SparkSession, path: str) -> DataFrame:
    """``(code, capture_id, page_no, detail)``: captured lines that yield no
    rows, as data: ``BAD_JSON`` (detail: the line), ``NO_VALUES`` (no array of
    rows in the page), ``EMPTY_PAGE``. Blank lines are no captures."""
    d = spark.read.text(path).filter(F.trim("value") != "").select("value", F.try_parse_json("value").alias("p"))
    rows = F.try_variant_get("p", "$.values", "array<variant>")
    code = (F.when(F.col("p").isNull(), "BAD_JSON").when(rows.isNull(), "NO_VALUES").when(F.size(rows) == 0, "EMPTY_PAGE"))
    return d.select(code.alias("code"), F.try_variant_get("p", "$.capture_id", "string").alias("capture_id"),
                    F.try_variant_get("p", "$.page_no", "bigint").alias("page_no"),
                    F.when(F.col("p").isNull(), F.col("value")).alias("detail")).filter("code is not null")


def page_list(pages: DataFrame, page_col: str = "page") -> DataFrame:
    """``(dataset, capture_id, page_no)``: every page that was read, also those
    without rows; stop rules count these."""
    p = F.col(page_col)
    return pages.select(F.try_variant_get(p, "$.dataset", "string").alias("dataset"),
                        F.try_variant_get(p, "$.capture_id", "string").alias("capture_id"),
                        F.try_variant_get(p, "$.page_no", "bigint").alias("page_no")).filter("page_no is not null").distinct()


def explode_rows(pages: DataFrame, page_col: str = "page", captured_at: str | None = None) -> DataFrame:
    """SRC-1 / SRC-2 (/ SRC-3 rows): one landing row per grid row, ragged
    form; the same scan serves every dataset.

    A page whose ``values`` is missing or not an array gives no rows.
    ``captured_at`` names a column for the page's capture time.
    """
    p = F.col(page_col)
    when = [F.try_variant_get(p, "$.captured_at", "timestamp").alias(captured_at)] if captured_at else []
    return (
        pages.select(
            *when,
            F.try_variant_get(p, "$.dataset", "string").alias("dataset"),
            F.try_variant_get(p, "$.capture_id", "string").alias("capture_id"),
            F.try_variant_get(p, "$.page_no", "bigint").alias("page_no"),
            F.try_variant_get(p, "$.values", "array<variant>").alias("rows"),
        )
        .select("dataset", "capture_id", *([captured_at] if captured_at else []), "page_no",
                F.posexplode("rows").alias("row_no", "row"))
        .withColumn("row_no", F.col("row_no").cast("bigint"))
    )


def strict_cells(row: Column) -> Column:
    """Ragged VARIANT row → ``ARRAY<ARRAY<STRING>>``; a cell that is not an
    array becomes NULL (instead of nulling the whole row as ``from_json``
    does). A row that is not an array becomes NULL."""
    return F.transform(
        F.try_variant_get(row, "$", "array<variant>"),
        lambda cell: F.try_variant_get(cell, "$", "array<string>"),
    )


def to_strict(landing: DataFrame) -> DataFrame:
    """Ragged landing rows → strict landing rows."""
    return landing.withColumn("cells", strict_cells(F.col("row"))).drop("row")


def reported_totals(pages: DataFrame, field: str = "total", page_col: str = "page") -> DataFrame:
    """SRC-8/9: the reported-total field per capture: digits only → BIGINT,
    anything else → NULL. One row per capture (first page that carries it)."""
    p = F.col(page_col)
    raw = pages.select(
        F.try_variant_get(p, "$.dataset", "string").alias("dataset"),
        F.try_variant_get(p, "$.capture_id", "string").alias("capture_id"),
        F.try_variant_get(p, "$.page_no", "bigint").alias("page_no"),
        F.try_variant_get(p, f"$.{field}", "string").alias("raw_total"),
    ).filter(F.col("raw_total").isNotNull())
    return raw.groupBy("dataset", "capture_id").agg(
        digits_or_null(F.min_by("raw_total", "page_no")).alias("total_available"))


def grid_from_table(df: DataFrame, key: str | Column, cells: Sequence[Column], *,
                    dataset: str, capture_id: str = "c0", page_size: int = 1000) -> DataFrame:
    """Lay rows of an existing table out as landed grid pages.

    ``page_no = key div page_size``, ``row_no = key mod page_size``; each
    entry of ``cells`` must be an ``ARRAY<STRING>`` column (a NULL entry drops
    out of the row, so short rows can be expressed). Pure projection: no
    shuffle.
    """
    k = F.col(key) if isinstance(key, str) else key
    return df.select(
        F.lit(dataset).alias("dataset"),
        F.lit(capture_id).alias("capture_id"),
        F.floor(k / F.lit(page_size)).cast("bigint").alias("page_no"),
        F.pmod(k, F.lit(page_size)).cast("bigint").alias("row_no"),
        F.filter(F.array(*cells), lambda c: c.isNotNull()).alias("cells"),
    )


def filled_arrays(page: Column, names: Sequence[str]) -> Column:
    """The named arrays of a page that have rows, as ``main, size, ord, name``."""
    return F.filter(F.array(*[F.struct(
        F.lit(k == 0).alias("main"), F.size(F.try_variant_get(page, f"$.{n}", "array<variant>")).alias("size"),
        F.lit(-k).alias("ord"), F.lit(n).alias("name")) for k, n in enumerate(names)]), lambda x: x["size"] > 0)


def fallback_rows(pages: DataFrame, names: Sequence[str], page_col: str = "page") -> DataFrame:
    """SRC-4 + SRC-5 as rows: per page the first of the named arrays when it
    has rows, else the largest of the others (ties: first named); landing rows
    ``capture_id, page_no, source, row_no, row`` for ``bind.bind_generic``. The
    choice is made inside the page: no shuffle. Pages without any such array
    give no rows; their tables are read by ``sources.html``."""
    p = F.col(page_col)
    found = filled_arrays(p, names)
    best = F.array_max(F.transform(found, lambda x: F.struct(
        x["main"].alias("main"), F.when(x["main"], 0).otherwise(x["size"]).alias("size"), x["ord"].alias("ord"),
        x["name"].alias("name"))))
    rows = F.coalesce(*[F.when(F.col("source") == n, F.try_variant_get(p, f"$.{n}", "array<variant>")) for n in names])
    return (once(pages.select(p), page_col).select(p, F.try_variant_get(p, "$.capture_id", "string").alias("capture_id"),
                         F.try_variant_get(p, "$.page_no", "bigint").alias("page_no"), best["name"].alias("source"))
            .filter("source is not null").select("capture_id", "page_no", "source", F.posexplode(rows).alias("row_no", "row")))


def choose_source(candidates: DataFrame, key: Sequence[str] = ("capture_id",)) -> DataFrame:
    """SRC-4: ordered source fallback. ``candidates`` has one row per
    (capture, source) with ``priority`` (lower first) and ``n_rows``; keep,
    per capture, the lowest-priority source that has rows.

    ``min_by`` over a partial aggregate: one row per key leaves each map task.
    """
    ok = candidates.filter(F.col("n_rows") > 0)
    return ok.groupBy(*key).agg(
        F.min_by("source", F.struct("priority", "source")).alias("source"),
        F.min("priority").alias("priority"),
    )


def largest_array(candidates: DataFrame, key: Sequence[str] = ("capture_id",)) -> DataFrame:
    """SRC-5: among named arrays (``name``, ``ord`` = search order, ``size``),
    pick the largest; ties go to the first found; empty arrays never win."""
    ok = candidates.filter(F.col("size") > 0)
    return ok.groupBy(*key).agg(
        F.max_by("name", F.struct(F.col("size"), -F.col("ord"))).alias("name"),
        F.max("size").alias("size"),
    )
