"""Counts, totals, flags and reconciliation (AGG-1..AGG-15).

All aggregates are partial + final (map-side combine). Ordered list results
(``collect_list``) are sorted by an explicit sequence column, because the
order ``collect_list`` sees is not defined.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import quote
from ..functions.text import py_strip


def batch_summary_exprs(seq: str = "seq", errors: str = "errors") -> dict[str, Column]:
    """AGG-2..AGG-6 + AGG-12 as aggregate expressions over a runs table, so a
    whole batch summary is one aggregate (one pass, map-side combine)."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return {
        "n_runs": F.count(F.lit(1)).cast("bigint"),
        "total_records": F.sum("extracted_count").cast("bigint"),
        "total_time": F.sum("extraction_time"),
        "all_success": F.bool_and(ok),
        "n_success": F.count_if(ok).cast("bigint"),
        "n_failed": F.count_if(~ok).cast("bigint"),
        "errors": F.flatten(F.transform(F.array_sort(F.collect_list(
            F.struct(F.col(seq).alias("s"), F.col(errors).alias("v")))), lambda x: x["v"])),
        "total_available": F.nullif(F.sum(F.coalesce("total_available", F.lit(0))), F.lit(0)).cast("bigint"),
        "data_types": F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq), F.col("data_type")))),
                                  lambda x: x["data_type"]),
    }


def count_rows(df: DataFrame, out: str = "extracted_count") -> DataFrame:
    """AGG-1."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias(out))


def batch_totals(runs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """AGG-2: sum of counts and of times."""
    return runs.groupBy(*group).agg(
        F.sum("extracted_count").cast("bigint").alias("total_records"),
        F.sum("extraction_time").alias("total_time"))


def combined_summary(runs: DataFrame, seq: str = "seq") -> DataFrame:
    """AGG-3: total extracted (NULL as 0), total available (NULL as 0, a zero
    sum → NULL) and the dataset list in run order."""
    return runs.agg(
        F.sum(F.coalesce("extracted_count", F.lit(0))).cast("bigint").alias("total_extracted"),
        F.nullif(F.sum(F.coalesce("total_available", F.lit(0))), F.lit(0)).cast("bigint").alias("total_available"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq), F.col("data_type")))),
                    lambda x: x["data_type"]).alias("data_types"))


def per_dataset_summary(runs: DataFrame) -> DataFrame:
    """AGG-4: count, time and success per dataset."""
    return runs.groupBy("data_type").agg(
        F.sum("extracted_count").cast("bigint").alias("extracted_count"),
        F.sum("extraction_time").alias("extraction_time"),
        F.bool_and("success").alias("success"))


def all_success(runs: DataFrame, flag: str = "success", extra: Column | None = None) -> DataFrame:
    """AGG-5: every run succeeded (and, optionally, the save did too)."""
    c = F.bool_and(F.coalesce(F.col(flag), F.lit(False)))
    if extra is not None:
        c = c & extra
    return runs.agg(c.alias("all_success"))


def concat_in_order(df: DataFrame, lists: str, seq: str, out: str | None = None,
                    group: Sequence[str] = ()) -> DataFrame:
    """AGG-6: concatenate per-run message lists in run order."""
    return df.groupBy(*group).agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(lists).alias("v")))),
        lambda x: x["v"])).alias(out or lists))


def exclusion_counts(df: DataFrame, keep: Column, name: str = "Individual Name") -> DataFrame:
    """AGG-7 + AGG-8 in one pass: rows excluded by a filter (``~keep``), rows
    kept with an empty name, and the warning texts."""
    excluded = F.count_if(~F.coalesce(keep, F.lit(True)))
    empty = F.count_if(F.coalesce(keep, F.lit(True)) & (py_strip(F.coalesce(F.col(quote(name)), F.lit(""))) == ""))
    return df.agg(excluded.cast("bigint").alias("excluded_count"),
                  empty.cast("bigint").alias("empty_name_count")).select(
        "excluded_count", "empty_name_count",
        F.when(F.col("excluded_count") > 0, F.format_string(
            "Excluded %d entities using exclusion patterns", F.col("excluded_count"))).alias("exclusion_warning"),
        F.when(F.col("empty_name_count") > 0, F.format_string(
            "Found %d entities with empty names", F.col("empty_name_count"))).alias("empty_name_warning"))


def coverage(extracted: Column | str, total: Column | str) -> Column:
    """AGG-9: ``struct(coverage_pct, coverage_status)``: percent with one
    decimal (decimal arithmetic, half up), and ``complete`` / ``missing n`` /
    ``extra n``; NULL when the total is 0 or NULL."""
    e = F.col(extracted) if isinstance(extracted, str) else extracted
    t = F.col(total) if isinstance(total, str) else total
    ok = t.isNotNull() & (t != 0)
    pct = F.round(e.cast("decimal(38,6)") * F.lit(100) / t.cast("decimal(38,6)"), 1).cast("double")
    status = (F.when(e == t, F.lit("complete"))
              .when(e < t, F.concat(F.lit("missing "), (t - e).cast("string")))
              .otherwise(F.concat(F.lit("extra "), (e - t).cast("string"))))
    return F.struct(F.when(ok, pct).alias("coverage_pct"), F.when(ok, status).alias("coverage_status"))


def outcome_counts(runs: DataFrame, flag: str = "success") -> DataFrame:
    """AGG-12: successful and failed runs."""
    f = F.coalesce(F.col(flag), F.lit(False))
    return runs.agg(F.count_if(f).cast("bigint").alias("n_success"),
                    F.count_if(~f).cast("bigint").alias("n_failed"))


def page_stats(rows: DataFrame, key: str, group: Sequence[str] = ("dataset", "capture_id")) -> DataFrame:
    """AGG-14: pages processed, unique keys, records. Distinct counts run as
    aggregate-on-aggregate (partial per key first), not one task per group."""
    return rows.groupBy(*group).agg(
        F.countDistinct("page_no").cast("bigint").alias("batches_processed"),
        F.countDistinct(quote(key)).cast("bigint").alias("unique_found"),
        F.count(F.lit(1)).cast("bigint").alias("total_records"))


def numbered_summary(errors: Column, warnings: Column) -> Column:
    """AGG-15: ``Found n validation error(s):`` then ``  i. text`` lines, then
    ``Warnings (n):`` and its lines; ``No validation errors`` when there are
    no errors. Error texts are expected as ``Invalid <field>: <message>``."""
    def lines(arr: Column) -> Column:
        return F.array_join(F.transform(arr, lambda x, i: F.format_string("  %d. %s", i + 1, x)), "\n")
    errors = F.coalesce(errors, F.array().cast("array<string>"))
    warnings = F.coalesce(warnings, F.array().cast("array<string>"))
    head = F.concat(F.format_string("Found %d validation error(s):\n", F.size(errors)), lines(errors))
    warn = F.when(F.size(warnings) > 0, F.concat(
        F.format_string("\n\nWarnings (%d):\n", F.size(warnings)), lines(warnings))).otherwise(F.lit(""))
    return F.when(F.size(errors) == 0, F.lit("No validation errors")).otherwise(F.concat(head, warn))


def error_text(field: Column, message: Column, suggestion: Column) -> Column:
    """Text of one validation error: ``Invalid <field>: <message>`` plus
    `` (Suggestion: ...)`` when there is one."""
    base = F.concat(F.lit("Invalid "), field, F.lit(": "), message)
    return F.when(F.coalesce(suggestion, F.lit("")) != "",
                  F.concat(base, F.lit(" (Suggestion: "), suggestion, F.lit(")"))).otherwise(base)
