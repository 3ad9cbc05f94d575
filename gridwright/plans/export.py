"""Extraction and export plans (PIP-1..PIP-6).

Everything here is driver-side orchestration of lazy plans: a request
compiles to a ``DataFrame`` per dataset; the only actions are the writes (and
one count per dataset for the run log). Failures while building or writing a
dataset become a failed run row, never an exception that stops the batch.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import once
from ..functions.text import py_strip
from ..operators import bind, dedup, filters, paging, project
from ..operators.windows import honor_stop_rules
from ..sinks import (RUNS_SCHEMA, inspection_document, output_paths, write_csv, write_document,
                     write_json_lines)
from ..sources.grid import LANDING_KEYS, fallback_rows, filled_arrays, to_strict
from ..sources.html import SCHEDULE_TABLE_CLASS, bind_header, html_rows, schedule_tables
from ..session import scratch_path
from ..sources.schema_files import DATASETS, ExportSchema, load_schema

# Formats allowed per export mode (TSV allowed in general mode,
# D-9).
MODE_FORMATS = {"general": ("json", "csv", "tsv"), "inspection": ("json",)}


@dataclass(frozen=True)
class PaginationConfig:
    page_size: int = 1000
    max_pages: int | None = None
    start_page: int = 1
    auto_paginate: bool = True


@dataclass(frozen=True)
class ExtractionQuery:
    """A request for one dataset; rejects unknown datasets."""
    data_type: str
    filters: Mapping[str, Any] = field(default_factory=dict)
    pagination: PaginationConfig | None = None
    metadata: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.data_type not in DATASETS:
            raise ValueError(f"Unsupported data type: {self.data_type}")


@dataclass
class Extraction:
    """Lazy records plus the run facts known without running them."""
    query: ExtractionQuery
    records: DataFrame | None
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    source_info: dict[str, str] = field(default_factory=dict)
    pagination_info: dict[str, str] = field(default_factory=dict)
    total_available: int | None = None
    facts: Observation | None = None  # excluded rows and empty names, counted while the records are computed

    @property
    def success(self) -> bool:
        return self.records is not None and not self.errors


BINDERS = {
    "water_systems": lambda landing: bind.bind_water_systems(_strict(landing)),
    "legal_entities": lambda landing: bind.bind_legal_entities(_strict(landing)),
    "deficiency_types": lambda landing: bind.bind_deficiency_types(landing),
    "sample_schedules": lambda landing: bind.bind_schedules(landing),
}


#: Datasets whose pages have other sources than the main array: how their HTML table is bound.
TABLE_SOURCES = {"deficiency_types": (bind.DEFICIENCY_TYPE_HEADERS, None), "sample_schedules": (bind.SAMPLE_SCHEDULE_HEADERS, SCHEDULE_TABLE_CLASS)}


def landing_with_fallback(pages: DataFrame, data_type: str, names: Sequence[str], page_col: str = "page",
                          html_col: str = "html") -> DataFrame:
    """SRC-3 / SRC-4 for ``extract`` and ``export``: landing rows of captured
    pages (VARIANT ``page_col`` with ``capture_id`` and ``page_no``, ``html_col``
    with the page's markup) from the first source that has rows: the main array
    (the first of ``names``), the largest other one, the page's table. Cells of a
    table are put in the dataset's order by their header; a header that is not
    there gives empty cells, of schedules absent ones. The choice is made inside the page."""
    headers, css_class = TABLE_SOURCES[data_type]
    arrays = fallback_rows(pages, names, page_col).select("capture_id", "page_no", "row_no", "row")
    p = F.col(page_col)
    open_ = once(pages, page_col).filter(F.size(filled_arrays(p, names)) == 0).select(
        F.try_variant_get(p, "$.capture_id", "string").alias("capture_id"), F.try_variant_get(p, "$.page_no", "bigint").alias("page_no"), html_col)
    ids = ["capture_id", "page_no"]
    if css_class:
        table = schedule_tables(open_, html_col, ids)
        cells = F.array(F.lit(None).cast("array<string>"), F.array(*[F.try_element_at("record", F.lit(h)) for h in headers]))
    else:
        table = bind_header(html_rows(open_, html_col, ids), [*ids, "table_no"])
        cells = F.array(*[F.coalesce(F.try_element_at("record", F.lit(h)), F.lit("")) for h in headers])
    rows = table.select(*ids, (F.col("row_index") - 1).cast("int").alias("row_no"), F.parse_json(F.to_json(cells)).alias("row"))
    return arrays.unionByName(rows).select(F.lit(data_type).alias("dataset"), "*")


def _strict(landing: DataFrame) -> DataFrame:
    return landing if "cells" in landing.columns else to_strict(landing)


def extract(spark: SparkSession, query: ExtractionQuery, landing: DataFrame | None, *,
            dedup_keys: Sequence[str] | None = None, honor_stop: bool = False, pages: DataFrame | None = None,
            totals: DataFrame | None = None) -> Extraction:
    """PIP-1: landed pages of one dataset → bound, filtered, de-duplicated
    records. Exclusion patterns (FLT-5/6) and search parameters (FLT-7)
    from ``query.filters`` are honoured (D-8); paging (SRT-2) when the query
    carries pagination with ``max_pages``; stop rules only on request (D-4).
    Rows that the patterns leave out and empty names are observed in the pass
    that computes the records (``facts``); ``pagination_info`` has the number
    of pages that were read.

    A capture is one read of the source, so keep-first and stop rules work per
    capture. ``pages`` (``sources.grid.page_list``) names every page that was
    read, those without rows too; without it the pages of the landed rows
    count. ``totals`` (``sources.grid.reported_totals``) gives the totals that
    the source reported: run metadata, one row per capture."""
    q = query
    try:
        if landing is None:
            raise ValueError("no landed pages were given")
        raw = landing.filter(F.col("dataset") == q.data_type) if "dataset" in landing.columns else landing
        rows = BINDERS[q.data_type](raw)
        warnings: list[str] = []
        sp = q.filters.get("search_params")
        if sp:
            rows = filters.search(rows, sp, SEARCH_FIELDS.get(q.data_type))
        capture = [c for c in ("dataset", "capture_id") if c in rows.columns]
        name = bind.KEY_COLUMN[q.data_type]
        keys = list(dedup_keys or [name])
        # the source does not de-duplicate deficiency types; keys given for them are honoured
        kept = rows if q.data_type == "deficiency_types" and not dedup_keys else dedup.keep_first(rows, capture + keys)
        pats = list(q.filters.get("exclusion_patterns", []) or [])
        checks = filters.check_patterns(spark, pats) if pats else []
        warnings += [f"Skipped exclusion pattern {c.pattern!r}: {c.error}" for c in checks if not c.valid]
        used = [c.pattern for c in checks if c.valid]
        out_by = filters.matches_any(name, used) if used else F.lit(False)
        empty = py_strip(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) == ""
        # counted in the pass that computes the records, after the de-duplication as the source does
        facts = Observation(f"facts-{uuid.uuid4().hex}")
        out = kept.observe(facts, F.count_if(out_by).alias("excluded"), F.count_if(empty & ~out_by).alias("empty_names"))
        if used:
            out = filters.exclude_patterns(out, name, used)
        if honor_stop:
            stats = page_new_counts(rows, kept, pages if pages is not None else raw, capture)
            out = honor_stop_rules(out, stats, q.pagination.page_size if q.pagination else 1000, capture)
        at = [c for c in ("dataset", "capture_id", "page_no") if c in (pages if pages is not None else raw).columns]
        info = {"pages": str((pages if pages is not None else raw).select(*at).distinct().count())} if "page_no" in at else {}
        if q.pagination and q.pagination.max_pages:
            p = q.pagination
            order = [c for c in ("captured_at", "capture_id", "page_no", "row_no") if c in out.columns]
            out = paging.offset_page(out.withColumnRenamed("page_no", "_landed_page"),
                                     [c if c != "page_no" else "_landed_page" for c in order], p.page_size, p.start_page,
                                     p.max_pages).drop("row_in_page", "_landed_page").withColumnRenamed("page_no", "result_page")
            info |= {"page_size": str(p.page_size), "start_page": str(p.start_page), "max_pages": str(p.max_pages)}
        out.schema  # analysis errors surface here, as a failed run
        total = None
        if totals is not None:
            mine = totals.filter(F.col("dataset") == q.data_type) if "dataset" in totals.columns else totals
            total = mine.agg(F.sum("total_available")).first()[0]
        return Extraction(q, out, [], warnings, {"extraction_method": "landed_pages", "dedup_keys": ",".join(keys)}, info, total, facts)
    except Exception as e:  # noqa: BLE001 — a failed extraction is a result
        return Extraction(q, None, [f"{q.data_type} extraction failed: {e}"])


# Search parameter names of each dataset's search form.
SEARCH_FIELDS = {
    "sample_schedules": {"pws_id": "PWS ID", "facility_id": "Facility ID", "schedule_type": "Schedule Type",
                         "active_only": "Status", "sample_count_unit": "Sample Count"},
    "deficiency_types": {"type_code": "Type Code", "category_code": "Default Category Code",
                         "severity_code": "Default Severity Code"},
    "water_systems": {"pws_id": "Water System No.", "active_only": "Activity Status"},
    "legal_entities": {"active_only": "Status"},
}


#: Columns that say where a record was read; exports hold the record alone.
LANDING_COLUMNS = (*LANDING_KEYS, "captured_at", "result_page")


def without_landing(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in LANDING_COLUMNS if c in df.columns])


def prepare_export(frames: Mapping[str, DataFrame], schema: ExportSchema, mode: str,
                   selected: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """PIP-5: single or multi dataset preparation for export: selection and
    order (PRJ-8), projection (PRJ-6/7), inspection skip and key order
    (PRJ-9/10); landing columns are dropped."""
    clean = {k: without_landing(v) for k, v in frames.items()}
    return project.transform_datasets(clean, schema, mode, selected)


def page_new_counts(rows: DataFrame, kept: DataFrame, pages: DataFrame | None = None,
                    capture: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Per page that was read (``pages``, also those without a valid row):
    valid rows and rows that were new (kept by keep-first)."""
    k = [*capture, "page_no"]
    valid = rows.groupBy(*k).agg(F.count(F.lit(1)).alias("n_valid"))
    new = kept.groupBy(*k).agg(F.count(F.lit(1)).alias("n_new"))
    read = (pages if pages is not None else rows).select(*k).distinct()
    return read.join(valid, k, "left").join(new, k, "left").fillna(0, ["n_valid", "n_new"])


def _run_row(spark: SparkSession, ex: Extraction, seq: int, count: int | None, seconds: float,
             run_id: str, extra: Mapping[str, str]) -> DataFrame:
    info = dict(ex.source_info)
    info.update(extra)
    row = (run_id, seq, ex.query.data_type, ex.success, int(count or 0), float(seconds), ex.total_available,
           datetime.now(), info, dict(ex.pagination_info), list(ex.errors), list(ex.warnings))
    return spark.createDataFrame([row], RUNS_SCHEMA)


def run_batch(spark: SparkSession, extractions: Sequence[Extraction], destinations: Sequence[str] | None = None,
              fmt: str = "csv", schema: ExportSchema | None = None, mode: str = "general",
              max_parallel: int = 1) -> DataFrame:
    """PIP-2: run extractions in order; each is written when a destination is
    given; one failure does not stop the rest. Returns the run rows with batch
    provenance (batch index, total, id) in ``source_info`` (PRJ-19).

    ``max_parallel > 1`` submits the dataset writes as concurrent Spark jobs
    from driver threads, which helps when datasets are small next to the
    cluster; each thread names its own scheduler pool, which shares the
    cluster fairly when the session runs ``spark.scheduler.mode=FAIR``. Run
    rows keep batch order."""
    if destinations is not None and len(destinations) != len(extractions):
        raise ValueError(f"{len(extractions)} extractions need as many destinations, got {len(destinations)}")
    run_id = uuid.uuid4().hex
    batch_id = f"{datetime.now():%Y%m%dT%H%M%S}-{run_id[:8]}"

    def one(i: int) -> DataFrame:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"batch_{i % max(1, max_parallel)}")
        return _run_one(spark, extractions, destinations, fmt, schema, mode, i, run_id, batch_id)

    if max_parallel > 1 and len(extractions) > 1:
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(max_workers=max_parallel) as pool:
            runs = list(pool.map(one, range(len(extractions))))
    else:
        runs = [one(i) for i in range(len(extractions))]
    return dedup.union_by_name(runs) if runs else spark.createDataFrame([], RUNS_SCHEMA)


def _run_one(spark: SparkSession, extractions: Sequence[Extraction], destinations: Sequence[str] | None,
             fmt: str, schema: ExportSchema | None, mode: str, i: int, run_id: str, batch_id: str) -> DataFrame:
    """Write (or count) one extraction and return its run row."""
    ex = extractions[i]
    t0 = time.time()
    count = None
    if ex.success:
        try:
            df = without_landing(ex.records)
            if schema is not None:
                df = project.transform_datasets({ex.query.data_type: df}, schema, mode).get(ex.query.data_type, df)
            if destinations is not None:
                # the row count is observed during the write: one pass
                obs = Observation(f"run_{i}")
                save(df.observe(obs, F.count(F.lit(1)).alias("n")), destinations[i], fmt)
                count = obs.get["n"]
            else:
                count = df.count()
            _add_warnings(ex, count)
        except Exception as e:  # noqa: BLE001 — a failed write is a failed run
            ex.errors.append(f"Failed to save {ex.query.data_type}: {e}")
    return _run_row(spark, ex, i, count, time.time() - t0, run_id,
                    {"batch_index": str(i), "batch_total": str(len(extractions)), "batch_id": batch_id})


def _add_warnings(ex: Extraction, count: int) -> None:
    """AGG-7..9 as run warnings: rows left out by patterns, rows without a
    name, and a count that differs from the reported total; AGG-14: the records
    of the run beside its pages."""
    got = ex.facts.get if ex.facts is not None else {}
    if got.get("excluded"):
        ex.warnings.append(f"Excluded {got['excluded']} records by exclusion patterns")
    if got.get("empty_names"):
        ex.warnings.append(f"{got['empty_names']} records have an empty {bind.KEY_COLUMN[ex.query.data_type]}")
    if ex.total_available is not None and ex.total_available != count and "max_pages" not in ex.pagination_info:
        ex.warnings.append(f"{count} records extracted, the source reported {ex.total_available}")
    ex.pagination_info["records"] = str(count)


def save(df: DataFrame, path: str, fmt: str) -> None:
    """Write one dataset: CSV / TSV (flattened) or JSON lines."""
    if fmt == "csv":
        write_csv(df, path)
    elif fmt == "tsv":
        write_csv(df, path, sep="\t")
    elif fmt == "json":
        write_json_lines(df, path)
    else:
        raise ValueError(f"Unsupported output format: {fmt}")


@dataclass(frozen=True)
class ExportConfiguration:
    data_types: tuple[str, ...]
    export_mode: str = "general"
    output_format: str = "csv"
    output_path: str | None = None
    output_dir: str = "."
    filters: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    pagination: PaginationConfig | None = None
    honor_stop: bool = False
    dedup_keys: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def check(self) -> list[str]:
        """Argument guards of an export request (plain Python)."""
        errs = []
        if not self.data_types:
            errs.append("at least one data type is required")
        bad = [t for t in self.data_types if t not in DATASETS]
        if bad:
            errs.append(f"Unsupported data types: {', '.join(bad)}")
        if self.export_mode not in MODE_FORMATS:
            errs.append(f"Unsupported export mode: {self.export_mode}")
        elif self.output_format not in MODE_FORMATS[self.export_mode]:
            errs.append(f"{self.export_mode} mode supports only: {', '.join(MODE_FORMATS[self.export_mode])}")
        return errs


def export(spark: SparkSession, cfg: ExportConfiguration, landings: Mapping[str, DataFrame],
           events_path: str | None = None, schema: ExportSchema | None = None,
           pages: Mapping[str, DataFrame] | None = None, totals: DataFrame | None = None) -> dict[str, Any]:
    """PIP-3 / PIP-4 / PIP-6: validate → extract each dataset → save (one
    file set per dataset, or one inspection document) → summary; audit events
    (started / completed / failed) are appended to ``events_path``. Whatever
    fails, ``export`` returns a result and the last event says how it ended."""
    export_id = uuid.uuid4().hex
    try:
        return _export(spark, cfg, landings, events_path, schema, pages or {}, totals, export_id)
    except Exception as e:  # noqa: BLE001 — a failed export is a result
        audit(spark, events_path, export_id, "export_failed", "error", {"error": str(e)})
        return {"success": False, "completed": False, "all_success": False, "errors": [str(e)], "runs": None,
                "export_id": export_id}


def _export(spark: SparkSession, cfg: ExportConfiguration, landings: Mapping[str, DataFrame], events_path: str | None,
            schema: ExportSchema | None, pages: Mapping[str, DataFrame], totals: DataFrame | None,
            export_id: str) -> dict[str, Any]:
    audit(spark, events_path, export_id, "export_started", "info", {"data_types": ",".join(cfg.data_types)})
    errs = cfg.check()
    if errs:
        audit(spark, events_path, export_id, "export_failed", "error", {"error": "; ".join(errs)})
        return {"success": False, "completed": False, "all_success": False, "errors": errs, "runs": None}
    schema = schema or load_schema(spark, "inspection_report" if cfg.export_mode == "inspection" else "general_export")
    ts = datetime.now().strftime("%Y%m%d_%H%M%S")
    exts = [extract(spark, ExtractionQuery(t, cfg.filters.get(t, {}), cfg.pagination), landings.get(t),
                    dedup_keys=cfg.dedup_keys.get(t), honor_stop=cfg.honor_stop, pages=pages.get(t), totals=totals)
            for t in cfg.data_types]
    ext = {"csv": ".csv", "tsv": ".tsv", "json": ".json"}[cfg.output_format]
    paths = output_paths(list(cfg.data_types), cfg.output_path, ts, ext, cfg.export_mode, cfg.output_dir)
    if cfg.export_mode == "inspection":
        for e in exts:
            if e.success and schema.rules(e.query.data_type) is None:
                e.errors.append(f"{e.query.data_type} has no fields in the inspection schema: nothing to write")
        # each dataset is computed once: projected and stored, then counted and written from there; what fails is left out
        frames = {}
        for e in exts:
            try:
                if e.success:
                    e.records = frames[e.query.data_type] = written_projection(spark, e, schema)
            except Exception as err:  # noqa: BLE001 — one failing dataset does not end the report
                e.errors.append(f"Failed to compute {e.query.data_type}: {err}")
        runs = run_batch(spark, exts, None)
        if frames:
            order = {t: ["_arrival"] for t in frames}
            write_document(inspection_document(frames, order), paths["inspection"])
    else:
        runs = run_batch(spark, exts, [paths[e.query.data_type] for e in exts], cfg.output_format, schema, "general")
    flags = runs.agg(F.bool_and("success").alias("ok"), F.count(F.lit(1)).alias("n")).first()
    all_ok = bool(flags["ok"])
    failed = {} if all_ok else {"failed": ",".join(e.query.data_type for e in exts if not e.success)}
    audit(spark, events_path, export_id, "export_completed", "info" if all_ok else "warning",
          {"all_success": str(all_ok).lower(), **failed})
    return {"success": True, "completed": True, "all_success": all_ok, "errors": [], "runs": runs,
            "paths": paths, "export_id": export_id}


def written_projection(spark: SparkSession, ex: Extraction, schema: ExportSchema) -> DataFrame:
    """The inspection fields of one dataset, stored once in the shared folder
    with their arrival order in ``_arrival``."""
    rules = schema.rules(ex.query.data_type)
    order = [c for c in ("captured_at", "capture_id", "result_page", "page_no", "row_no") if c in ex.records.columns]
    df = ex.records.select(*[project.rule_column(ex.records, r) for r in rules.fields],
                           F.struct(*order).alias("_arrival"))
    path = scratch_path(spark, f"inspection-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("event_type", T.StringType()), T.StructField("aggregate_id", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("context", T.MapType(T.StringType(), T.StringType())),
])


def audit(spark: SparkSession, path: str | None, aggregate_id: str, event_type: str, severity: str,
          context: Mapping[str, str]) -> None:
    """PIP-6: append one audit event to the events table (no-op without a path)."""
    if not path:
        return
    row = (uuid.uuid4().hex, datetime.now(), event_type, aggregate_id, severity, dict(context))
    spark.createDataFrame([row], EVENT_SCHEMA).write.mode("append").parquet(path)
