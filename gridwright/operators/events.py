"""Event log queries (FLT-10, AGG-10).

Events are a table ``(event_id, timestamp, event_type, aggregate_id,
severity, context MAP, ...)``; insertion order is an explicit sequence column
(``event_id``), never file order.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_events(events: DataFrame, aggregate_id=None, event_type=None, after=None,
                  aggregate_col: str = "aggregate_id", type_col: str = "event_type",
                  ts_col: str = "timestamp") -> DataFrame:
    """FLT-10: each criterion optional, ANDed; the time test is strictly
    after. Plain comparisons: pushed down to the Parquet scan."""
    if aggregate_id:
        events = events.filter(F.col(aggregate_col) == F.lit(aggregate_id))
    if event_type:
        events = events.filter(F.col(type_col) == F.lit(event_type))
    if after is not None:
        events = events.filter(F.col(ts_col) > F.lit(after))
    return events


def event_statistics(events: DataFrame, seq: str = "event_id", ts_col: str = "timestamp",
                     type_col: str = "event_type", severity_col: str | None = "severity",
                     group: Sequence[str] = ()) -> DataFrame:
    """AGG-10: total, first and last timestamp by insertion order (not
    min/max of the time), counts by type and by severity as maps. The
    per-type counts are a partial aggregate first, so a hot type is summed
    map-side."""
    g = list(group)
    total = events.groupBy(*g).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_events"),
        F.min_by(ts_col, seq).alias("first_event_timestamp"),
        F.max_by(ts_col, seq).alias("last_event_timestamp"))
    by_type = (events.groupBy(*g, type_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
               .groupBy(*g).agg(F.map_from_entries(F.array_sort(F.collect_list(
                   F.struct(F.col(type_col), F.col("n"))))).alias("event_type_counts")))
    out = total.join(by_type, g, "inner") if g else total.select("*", by_type.scalar().alias("event_type_counts"))
    if severity_col and severity_col in events.columns:
        by_sev = (events.groupBy(*g, severity_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
                  .groupBy(*g).agg(F.map_from_entries(F.array_sort(F.collect_list(
                      F.struct(F.col(severity_col), F.col("n"))))).alias("severity_counts")))
        out = out.join(by_sev, g, "inner") if g else out.select("*", by_sev.scalar().alias("severity_counts"))
    return out
