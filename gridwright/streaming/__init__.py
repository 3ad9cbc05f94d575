"""Structured Streaming forms of the incremental work (STR-1, STR-2, UDF-4).

* STR-1: landed pages arrive as files; the first row to arrive per key stays.
  The keys already seen are a bucketed table of files (``state.BatchTable``),
  so memory holds one batch whatever the number of keys. With an arrival
  timestamp ``dropDuplicatesWithinWatermark`` can forget old keys instead.
* STR-2: the event log as a stream: windowed counts per event type under a
  watermark, and per-batch handlers (``foreachBatch``); changed counts go to a
  ``BatchTable`` of one snapshot and a few deltas.

Sinks are files plus a checkpoint under the shared checkpoint folder, so a
lost executor or a restarted driver resumes where it stopped. ``availableNow``
processes what has landed and stops.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import quote
from ..operators.dedup import keep_first
from .state import BatchTable

#: Folders of the key table; a batch opens only those of its own keys.
KEY_BUCKETS = 64


def dedup_stream(stream: DataFrame, keys: Sequence[str], event_time: str | None = None,
                 delay: str = "1 day") -> DataFrame:
    """STR-1: keep the first row to arrive per key. With ``event_time`` the
    state is bounded by the watermark (``dropDuplicatesWithinWatermark``)."""
    keys = list(keys)
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def run_available(df: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet",
                  mode: str = "append", timeout_s: float | None = None) -> None:
    """Run a streaming plan over everything that has landed, then stop."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink))
    _finish(q, timeout_s)


def _finish(q, timeout_s: float | None) -> None:
    """Wait until all that has landed is processed; a time limit only on request."""
    q.awaitTermination(timeout_s) if timeout_s else q.awaitTermination()
    if q.isActive:
        q.stop()
        raise TimeoutError("stream did not finish in time")
    if q.exception() is not None:
        raise q.exception()


def keep_first_batches(keys: Sequence[str], sink: str, state: str, order: Sequence[str] = ("page_no", "row_no"),
                       buckets: int = KEY_BUCKETS) -> Callable[[DataFrame, int], None]:
    """STR-1, exact: a batch handler that appends the first row to arrive per
    key to ``sink``. Earlier batches come first; inside a batch ``order``
    decides (columns that are there; without any, the order of all columns).

    A batch is reduced to one row per key, keys of earlier batches are
    anti-joined away, and the rest is written to the batch's own folder of the
    sink before its keys are committed. A batch that runs again sees the keys
    of the batches before it and overwrites its folder: the result is the same.
    Rows with a NULL or empty key are left out, as in ``keep_first``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = BatchTable(spark, state, partition_by=["key_bucket"])
        by = [c for c in order if c in batch.columns] or [c for c in batch.columns if c not in keys]
        cols = [F.col(quote(k)) for k in keys]
        named = [c.alias(f"k{i}") for i, c in enumerate(cols)]
        first = keep_first(batch, list(keys), by).withColumn("key_bucket", F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int"))
        seen = table.rows(before=batch_id)
        if seen is not None:
            mine = [r[0] for r in first.select("key_bucket").distinct().collect()]  # at most ``buckets`` numbers
            seen = seen.filter(F.col("key_bucket").isin(mine)).drop("key_bucket", "batch_id")
            same = [c.eqNullSafe(F.col(f"k{i}")) for i, c in enumerate(cols)]
            first = first.join(seen, reduce(Column.__and__, same), "left_anti")
        folder = f"{sink}/batch_id={batch_id}"
        first.write.mode("overwrite").parquet(folder)
        stored = spark.read.schema(first.schema).parquet(folder)
        table.commit(batch_id, stored.select(*named, "key_bucket"))
    return handle


def _first_rows(spark: SparkSession, stream: DataFrame, keys: Sequence[str], sink: str, checkpoint: str,
                event_time: str | None, delay: str) -> DataFrame:
    """Run the dedup over all that has landed; the sink as a batch DataFrame."""
    if event_time:
        run_available(dedup_stream(stream, keys, event_time, delay), sink, checkpoint)
        return spark.read.parquet(sink)
    q = (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .foreachBatch(keep_first_batches(keys, sink, f"{checkpoint}-keys")).start())
    _finish(q, None)
    return spark.read.schema(stream.schema).parquet(sink)


def ingest_pages(spark: SparkSession, landing_dir: str, schema: T.StructType | str, keys: Sequence[str],
                 sink: str, checkpoint: str, fmt: str = "json", event_time: str | None = None,
                 max_files_per_trigger: int | None = None, delay: str = "1 day") -> DataFrame:
    """STR-1 end to end: stream the landing folder, keep the first row to
    arrive per key (``keep_first_batches``), append it to ``sink``; returns the
    sink as a batch DataFrame. With ``event_time`` keys older than ``delay``
    are forgotten instead."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = r.load(landing_dir)
    return _first_rows(spark, stream, keys, sink, checkpoint, event_time, delay)


def ingest_captures(spark: SparkSession, landing_dir: str, binder: Callable[[DataFrame], DataFrame],
                    keys: Sequence[str], sink: str, checkpoint: str,
                    max_files_per_trigger: int | None = None, event_time: str | None = None,
                    delay: str = "1 day") -> DataFrame:
    """STR-1 over captured page files (one JSON page per line): parse, explode
    rows, bind with ``binder`` (e.g. ``bind.bind_water_systems``), keep the
    first row to arrive per key (``keep_first_batches``), append to ``sink``.
    Lines that are no JSON are left out (``sources.grid.capture_issues`` lists
    them) and do not stop the stream. With ``event_time`` the page's
    ``captured_at`` (as that column) bounds the state by its watermark.
    Returns the sink as a batch DataFrame."""
    from ..sources.grid import explode_rows, to_strict
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    pages = r.load(landing_dir).select(F.try_parse_json("value").alias("page"))
    bound = binder(to_strict(explode_rows(pages, captured_at=event_time)))
    return _first_rows(spark, bound, keys, sink, checkpoint, event_time, delay)


def windowed_counts(stream: DataFrame, ts: str = "ts", by: Sequence[str] = ("event_type",),
                    window: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """STR-2: counts per (window, group) under a watermark; late rows beyond
    the watermark are dropped by Spark."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (stream.withWatermark(ts, delay).groupBy(w.alias("window"), *by)
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def latest_per_key(updates: DataFrame, keys: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """Current value per key from an update log, with its ``batch_id``
    (partial aggregate)."""
    return updates.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in value_cols], F.max("batch_id").alias("batch_id"))


def upsert_batches(path: str, keys: Sequence[str], value_cols: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """UDF-4 style batch handler for ``update`` output: the changed rows of a
    micro-batch are one delta of a ``BatchTable``, which keeps the latest row
    per key; a batch that runs again changes nothing."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        counts_table(batch.sparkSession, path, keys, value_cols).commit(batch_id, batch.select(*keys, *value_cols))
    return handle


def counts_table(spark: SparkSession, path: str, keys: Sequence[str], value_cols: Sequence[str]) -> BatchTable:
    return BatchTable(spark, path, lambda d: latest_per_key(d, keys, value_cols))


def event_counts(spark: SparkSession, source_dir: str, sink: str, checkpoint: str,
                 glob: str | None = None, window: str = "1 day", delay: str = "1 day",
                 schema: T.StructType | None = None, timeout_s: float | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """STR-2 end to end over parquet event files: windowed counts in
    ``update`` mode through ``foreachBatch``; returns ``(window_start,
    window_end, event_type, n)`` as a batch DataFrame. The changed counts of
    each batch go to a ``BatchTable`` in ``sink``."""
    r = spark.readStream.format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if schema is None:
        schema = (spark.read.option("pathGlobFilter", glob).parquet(source_dir) if glob
                  else spark.read.parquet(source_dir)).schema
    stream = r.schema(schema).load(source_dir)
    tz = spark.conf.get("spark.sql.session.timeZone")
    ntz = isinstance(schema["ts"].dataType, T.TimestampNTZType)
    if ntz:
        # Watermarks need TIMESTAMP. Map the wall-clock time to the instant
        # whose UTC wall clock it is, so day windows start at wall midnight
        # whatever the session time zone; mapped back below.
        stream = stream.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), tz))
    counts = windowed_counts(stream, "ts", ("event_type",), window, None, delay)

    def back(c):
        return F.to_utc_timestamp(c, tz).cast("timestamp_ntz") if ntz else c
    counts = counts.select(back(F.col("window.start")).alias("window_start"),
                           back(F.col("window.end")).alias("window_end"), "event_type", "n")
    keys = ["window_start", "window_end", "event_type"]
    q = (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(upsert_batches(sink, keys, ["n"])).trigger(availableNow=True).start())
    _finish(q, timeout_s)
    now = counts_table(spark, sink, keys, ["n"]).current()
    return spark.createDataFrame([], counts.schema) if now is None else now.drop("batch_id")


def publish(stream: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]],
            global_handlers: Sequence[Callable[[DataFrame, int], None]] = (),
            type_col: str = "event_type") -> Callable[[DataFrame, int], None]:
    """UDF-4 / STR-2: a ``foreachBatch`` function that hands each event type's
    rows to its handler and all rows to the global handlers (audit store,
    statistics). Handlers receive DataFrames, not rows."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        for t, h in handlers.items():
            h(batch.filter(F.col(type_col) == t), batch_id)
        for h in global_handlers:
            h(batch, batch_id)
    return handle
