"""File sinks: CSV / TSV with the source's text layout, JSON lines, the
metadata preamble and sidecar, multi-dataset CSV and output paths (SNK-1..5,
SNK-15). Row data is always written by the executors (``df.write``)."""

from __future__ import annotations

import os
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import quote
from ..functions.fmt import duration_text, iso_timestamp
from ..operators.dedup import combine_datasets
from ..operators.project import flatten
from .ordered import write_ordered

# CSV options that give the source's text layout: empty for NULL and '', a
# doubled quote inside quoted fields, and no trimming of spaces.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "quote": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "lineSep": "\n",
}
CSV_READ_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "multiLine": "true",
                    "emptyValue": "", "ignoreLeadingWhiteSpace": "false",
                    "ignoreTrailingWhiteSpace": "false"}

def _prepare(df: DataFrame, sort_columns: bool, flatten_nested: bool) -> DataFrame:
    if flatten_nested:
        df = flatten(df)
    if sort_columns:
        df = df.select(*[quote(c) for c in sorted(df.columns)])
    return df


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite",
              sort_columns: bool = False, flatten_nested: bool = True,
              single_file: bool = False) -> None:
    """SNK-1 (``sep=','``) / SNK-2 (``sep='\\t'``): header, NULL → empty,
    nested fields flattened (PRJ-11). ``single_file`` coalesces to one part
    file (for small exports only)."""
    out = _prepare(df, sort_columns, flatten_nested)
    if single_file:
        out = out.coalesce(1)
    out.write.mode(mode).options(**CSV_OPTIONS).option("sep", sep).csv(path)


def write_tsv(df: DataFrame, path: str, **kw) -> None:
    """SNK-2."""
    write_csv(df, path, sep="\t", **kw)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             sep: str = ",") -> DataFrame:
    r = spark.read.options(**CSV_READ_OPTIONS).option("sep", sep)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines; NULL fields kept (FN-22) — the scale path."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def metadata_rows(spark: SparkSession, runs: DataFrame, export_mode: str | None = None) -> DataFrame:
    """SNK-3: the metadata preamble as its own small table ``(seq, key,
    value)`` (a sidecar, never mixed into data rows): data type, extracted
    count, extraction time, timestamp, total available, and export mode."""
    r = runs.select(
        F.posexplode(F.array(
            F.struct(F.lit("Data Type").alias("k"), F.col("data_type").cast("string").alias("v")),
            F.struct(F.lit("Extracted Count").alias("k"), F.col("extracted_count").cast("string").alias("v")),
            F.struct(F.lit("Extraction Time").alias("k"), duration_text("extraction_time", "long").alias("v")),
            F.struct(F.lit("Timestamp").alias("k"), iso_timestamp("extraction_timestamp").alias("v")),
            F.struct(F.lit("Total Available").alias("k"), F.col("total_available").cast("string").alias("v")),
            F.struct(F.lit("Export Mode").alias("k"), F.lit(export_mode).cast("string").alias("v")),
        )).alias("seq", "kv"))
    return r.select("seq", F.col("kv.k").alias("key"), F.col("kv.v").alias("value")).filter(F.col("value").isNotNull())


def write_csv_with_preamble(df: DataFrame, runs: DataFrame, path: str, export_mode: str | None = None) -> None:
    """SNK-3 text form: preamble lines, a blank line, then the CSV header and
    rows, as an ordered text (``ordered.py``): the files in name order are the
    text. The preamble is the run row, a few lines, and is read on the driver.
    Column names are quoted where they must be."""
    spark = df.sparkSession
    meta = [r[0] for r in metadata_rows(spark, runs, export_mode).orderBy("seq").select(
        F.to_csv(F.struct("key", "value"), {"escape": '"'})).collect()]
    flat = flatten(df)
    header = ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n\r') or c != c.strip() else c for c in flat.columns)
    body = flat.select(F.to_csv(F.struct(*[quote(c) for c in flat.columns]), {
        "escape": '"', "nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false"}).alias("line"))
    write_ordered(spark, [[*meta, "", header], body], path)


def multi_dataset_csv(frames: Mapping[str, DataFrame], path: str, selected: Sequence[str] | None = None,
                      **kw) -> None:
    """SNK-5: one CSV, ``data_type`` first, union of all columns, missing
    values empty; nested values are always flattened (D-11)."""
    combined = combine_datasets({k: flatten(v) for k, v in frames.items()}, "data_type", selected)
    write_csv(combined, path, flatten_nested=False, **kw)


def output_paths(data_types: Sequence[str], base: str | None, ts: str, ext: str, mode: str = "general",
                 default_dir: str = ".") -> dict[str, str]:
    """SNK-15: one path per dataset: the given path itself when there is one
    dataset (or inspection mode: one document), else ``{stem}_{type}_{ts}{ext}``;
    without a path ``{type}_{ts}{ext}`` in ``default_dir``. Driver-side."""
    if mode == "inspection":
        p = base or os.path.join(default_dir, f"inspection_report_{ts}{ext}")
        return {"inspection": p}
    if base and len(data_types) == 1:
        return {data_types[0]: base}
    out = {}
    for t in data_types:
        if base:
            stem, e = os.path.splitext(base)
            out[t] = f"{stem}_{t}_{ts}{e or ext}"
        else:
            out[t] = os.path.join(default_dir, f"{t}_{ts}{ext}")
    return out
