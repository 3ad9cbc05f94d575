"""Exact dedup by a heavy-hitter split.

1. Digest every whole text once and write ``(row, doc_id, digest)``.
2. Each partition runs Misra-Gries with ``counters`` counters; the summaries
   are added up and the ``counters`` largest digests stay. A digest held by
   more than ``rows / (counters + 1)`` rows is always among them.
3. One map-side-reduced pass counts these candidates exactly; those that are
   truly frequent are the winners. At most ``counters`` rows: broadcast.
4. Rows of a winner are resolved map-side by the broadcast; all other digests,
   each now small against the table, go through an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import ASCII_SPACE, keep_one, text_key, written

COUNTERS = 1024  # bounds the broadcast: 1,024 rows of about 70 bytes


def misra_gries(keys: Iterator, counters: int) -> dict:
    """Misra-Gries summary: every key seen more than n / (counters + 1) times
    is in the result, with a count that is too low by that much at most."""
    held: dict = {}
    for k in keys:
        if k in held:
            held[k] += 1
        elif len(held) < counters:
            held[k] = 1
        else:
            held = {x: c - 1 for x, c in held.items() if c > 1}
    return held


def _digest_rows(docs: DataFrame) -> DataFrame:
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), ASCII_SPACE, " ")
    return docs.select(F.col("doc_id"), text_key(F.col("text")).alias("tk"), F.unhex(F.sha2(norm, 256)).alias("digest"),
                       F.monotonically_increasing_id().alias("row"))


def _group(rows: DataFrame) -> DataFrame:
    """One row per digest: the row that stays is the one with the smallest
    non-null doc_id; the row number of the written table settles the rest."""
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("f")
    return rows.groupBy("digest").agg(first, F.count("*").alias("group_size")).select(
        "digest", F.col("f.doc_id").alias("keep_id"), F.col("f.row").alias("keep_row"), "group_size")


def winners(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Groups of the verified frequent digests: at most ``counters`` rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = misra_gries((k for b in batches for k in b.column(0).to_pylist()), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                         names=["digest", "c"])

    summary = rows.select("digest").mapInArrow(summarise, "digest binary, c bigint")
    top = (summary.groupBy("digest").agg(F.sum("c").alias("c"))
           .orderBy(F.desc("c"), "digest").limit(counters).select("digest"))
    n = rows.count()
    exact = _group(rows.join(F.broadcast(top), "digest"))
    return written(exact.filter((F.col("group_size") > 1) & (F.col("group_size") * (counters + 1) > n)), "winners")


def resolve(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, tk, digest, keep_id, keep_row, row, group_size``."""
    rows = written(_digest_rows(docs), "digests")
    hot = F.broadcast(winners(rows, counters))
    rest = rows.join(hot.select("digest"), "digest", "left_anti")
    return rows.join(hot, "digest").unionByName(rest.join(_group(rest), "digest"))


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Texts are equal when they are identical after each run of ASCII white
    space became one space. Null text counts as empty. Of equal texts the row
    with the smallest doc_id stays; rows without id stay only if no row of the
    group has one; of rows with the same id and text just one is ``kept``.
    An empty table gives an empty result; other columns are ignored."""
    return resolve(docs, counters).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    r = resolve(docs, counters)
    same = r.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    keep = (same.groupBy("keep_row", "doc_id", "tk").agg(F.min("row").alias("first"), F.count("*").alias("copies"))
            .filter("first = keep_row").select("doc_id", "tk", "copies"))
    return keep_one(docs, written(keep, "kept"))
