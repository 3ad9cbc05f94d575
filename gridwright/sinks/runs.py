"""Run log (SNK-13): one row per extraction run, successful or failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("extracted_count", T.LongType()),
    T.StructField("extraction_time", T.DoubleType()),
    T.StructField("total_available", T.LongType()),
    T.StructField("extraction_timestamp", T.TimestampNTZType()),
    T.StructField("source_info", T.MapType(T.StringType(), T.StringType())),
    T.StructField("pagination_info", T.MapType(T.StringType(), T.StringType())),
    T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("warnings", T.ArrayType(T.StringType())),
])


def append_runs(runs: DataFrame, path: str) -> None:
    """SNK-13: append run rows (successful or failed) to the ``runs`` table."""
    runs.select(*[F.col(f.name).cast(f.dataType) for f in RUNS_SCHEMA.fields]) \
        .write.mode("append").parquet(path)
