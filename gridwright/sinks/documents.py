"""JSON documents (SNK-6..SNK-12), written in ordered parts.

A document is a list of parts: texts (the opening, keys, closings, the small
values of the tail) and record tables, one line per record. ``lines`` gives it
as a table ``(part, idx, line)``; ``write_document`` writes the parts as the
sections of an ordered text (``ordered.py``) with a manifest. Records are
range-partitioned by their order once, stored, and both forms read that copy:
several documents of the same records share one ``OrderedRecords``. No record
meets another in one task and no row limit is needed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions._util import quote
from ..operators.windows import positions, tie_break
from ..session import scratch_path
from .ordered import ranged, write_ordered


class OrderedRecords:
    """Records as JSON lines in ``order`` (without one: in the order of all
    columns), stored once; the order columns are not part of the records. NULL
    fields are kept."""

    def __init__(self, df: DataFrame, order: Sequence[str] | None = None):
        self.df, self.order = df, list(order or df.columns)
        self.fields = [c for c in df.columns if not order or c not in order]
        self._stored: DataFrame | None = None

    def _ranged(self) -> DataFrame:
        d = ranged(self.df, tie_break(self.df, self.order))
        return d.select("_piece", F.to_json(F.struct(*[F.col(quote(c)) for c in self.fields]), {"ignoreNullFields": "false"}).alias("line"))

    def positions(self) -> DataFrame:
        """``idx, line``: every record with its position; ranged once."""
        if self._stored is None:
            spark = self.df.sparkSession
            path = scratch_path(spark, f"records-{uuid.uuid4().hex}")
            at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
            d = self._ranged().withColumn("_gi_pid", F.col("_piece").cast("bigint")).withColumn("_gi_pos", at).drop("_piece")
            d.write.parquet(path)
            self._stored = spark.read.schema(d.schema).parquet(path)
        return positions(self._stored, "idx")

    def section(self) -> DataFrame:
        """The lines to write: a comma stands in front of every record but the
        first, which is the first row of the first range (ranges are cut at
        keys that occur, so the first one is empty only if all are)."""
        first = F.monotonically_increasing_id() == 0
        return self._ranged().withColumn("line", F.when(first, F.col("line")).otherwise(F.concat(F.lit(","), "line")))


@dataclass
class Document:
    """Parts of a document in order: text or ``OrderedRecords``."""
    spark: SparkSession
    parts: list = field(default_factory=list)

    def lines(self) -> DataFrame:
        """``(part, idx, line)``: sorted by the first two, the document."""
        out = []
        for k, p in enumerate(self.parts):
            if isinstance(p, OrderedRecords):
                comma = F.when(F.col("idx") > 0, F.lit(",")).otherwise(F.lit(""))
                out.append(p.positions().select(F.lit(k).alias("part"), "idx", F.concat(comma, F.col("line")).alias("line")))
            else:
                out.append(self.spark.range(1).select(F.lit(k).alias("part"), F.lit(0).cast("bigint").alias("idx"), F.lit(p).alias("line")))
        return reduce(DataFrame.unionByName, out)


def document(spark: SparkSession, records: Mapping[str, DataFrame | OrderedRecords], tail: Mapping[str, Any] | None = None,
             order: Mapping[str, Sequence[str]] | None = None) -> Document:
    """``{key: [records], ..., tail key: value, ...}``. Tail values are
    metadata: small Python values."""
    parts, first = ["{"], ""
    for key, df in records.items():
        rows = df if isinstance(df, OrderedRecords) else OrderedRecords(df, (order or {}).get(key))
        parts += [f"{first}{json.dumps(key)}: [", rows, "]"]
        first = ","
    for key, value in (tail or {}).items():
        parts.append(f"{first}{json.dumps(key)}: {json.dumps(value, ensure_ascii=False, separators=(',', ':'))}")
        first = ","
    return Document(spark, [*parts, "}"])


def records_of(doc: Document, part: int = 2) -> DataFrame:
    """``(pos, record)``: the records of one part, read back from its lines."""
    return doc.lines().filter(F.col("part") == part).select(
        F.col("idx").alias("pos"), F.regexp_replace("line", "^,", "").alias("record"))


def json_document(df: DataFrame, key: str, summary: Mapping[str, Any] | None = None,
                  order: Sequence[str] | None = None) -> Document:
    """SNK-6/7/9/10: one dataset under ``key``, an optional summary behind it."""
    return document(df.sparkSession, {key: df}, {"extraction_summary": dict(summary)} if summary is not None else None,
                    {key: order} if order else None)


def inspection_document(frames: Mapping[str, DataFrame], order: Mapping[str, Sequence[str]] | None = None) -> Document:
    """SNK-10 / SNK-11 / PRJ-10: one key per dataset present, in the
    inspection key order; projected records only, no envelope."""
    from ..operators.project import INSPECTION_ORDER
    names = [n for n in INSPECTION_ORDER if n in frames]
    if not names:
        raise ValueError("no dataset with rows to put in the document")
    return document(frames[names[0]].sparkSession, {n: frames[n] for n in names}, None, order)


def _iso(ts) -> str | None:
    return None if ts is None else ts.isoformat()


def _legacy_key(data_type: str) -> str:
    """PRJ-16, older list used by the plain JSON writers."""
    return data_type if data_type in ("legal_entities", "sample_schedules") else (
        "all_water_systems" if data_type == "water_systems" else f"all_{data_type}")


def run_document(records: DataFrame | OrderedRecords, run: DataFrame, style: str = "standard",
                 order: Sequence[str] | None = None) -> Document:
    """SNK-6 (``standard``: older output keys), SNK-7 (``detailed``: plus a
    ``metadata`` object), SNK-8 (``compact``: rows, count, timestamp) and
    SNK-9 (``general``: current output keys, ``export_mode`` inside the
    summary).

    ``run`` is the one-row run log entry of the records (``RUNS_SCHEMA``);
    being metadata, it is read on the driver. Optional summary parts
    (source/pagination info, errors, warnings) appear only when non-empty.
    """
    r = run.first().asDict()
    stamp, errs, warns = _iso(r["extraction_timestamp"]), list(r.get("errors") or []), list(r.get("warnings") or [])
    infos = {k: dict(sorted((r.get(k) or {}).items())) for k in ("source_info", "pagination_info")}
    if style == "general" and r["data_type"] in ("legal_entities", "sample_schedules", "deficiency_types"):
        key = r["data_type"]
    else:
        key = _legacy_key(r["data_type"])
    if style == "compact":
        tail: dict[str, Any] = {"count": r["extracted_count"], "timestamp": stamp}
        return document(run.sparkSession, {key: records}, tail, {key: order} if order else None)
    summary = {"total_extracted": r["extracted_count"], "expected_total": r["total_available"],
               "extraction_time": f"{r['extraction_time']:.2f}s", "timestamp": stamp, "success": bool(r["success"])}
    if style == "general":
        summary["export_mode"] = "general"
    summary.update({k: v for k, v in {**infos, "errors": errs, "warnings": warns}.items() if v})
    tail = {"extraction_summary": summary}
    if style == "detailed":
        tail["metadata"] = {
            "extraction_metadata": {"extracted_count": r["extracted_count"], "extraction_time": r["extraction_time"],
                                    "data_type": r["data_type"], "extraction_timestamp": stamp,
                                    "total_available": r["total_available"], **infos},
            "result_metadata": {"success": bool(r["success"]), "record_count": r["extracted_count"], "has_errors": bool(errs),
                                "has_warnings": bool(warns), "errors": errs, "warnings": warns}}
    return document(run.sparkSession, {key: records}, tail, {key: order} if order else None)


def general_document(frames: Mapping[str, DataFrame | OrderedRecords], runs: DataFrame, export_mode: str = "general",
                     selected: Sequence[str] | None = None, order: Mapping[str, Sequence[str]] | None = None,
                     timestamp=None) -> Document:
    """SNK-12: every selected dataset's rows under its own key, a combined
    ``extraction_summary`` (AGG-3, summed over *all* runs as the source does)
    and ``data_type_summaries`` (AGG-4). Runs are metadata (one row per
    dataset) and are read on the driver."""
    from datetime import datetime

    from ..operators.aggregates import combined_summary
    names = [n for n in (selected or list(frames)) if n in frames]
    c = combined_summary(runs).first()
    tail = {"extraction_summary": {"total_extracted": c["total_extracted"], "total_available": c["total_available"],
                                   "data_types": list(c["data_types"]), "timestamp": _iso(timestamp or datetime.now()),
                                   "export_mode": export_mode},
            "data_type_summaries": {r["data_type"]: {"extracted_count": r["extracted_count"], "extraction_time": r["extraction_time"],
                                                     "success": bool(r["success"])} for r in runs.orderBy("seq").collect()}}
    return document(runs.sparkSession, {n: frames[n] for n in names}, tail, order)


def write_document(doc: Document, path: str) -> None:
    """Write the document as an ordered text: the files in name order, which
    the manifest lists, are the document."""
    write_ordered(doc.spark, [p.section() if isinstance(p, OrderedRecords) else [p] for p in doc.parts], path)
