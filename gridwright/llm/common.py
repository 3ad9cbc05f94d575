"""Helpers shared by the operators: stable row keys, written intermediates,
fold arithmetic, temporary column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.session import scratch_path

ASCII_SPACE = r"[\x20\x09-\x0D]+"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back:
    a lost executor later re-reads the files instead of recomputing."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """``crc32(doc_id as text) mod parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def text_key(text: Column) -> Column:
    """64-bit key of a text; with doc_id it identifies a row's content."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_one(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``(doc_id, text_key)`` is in ``keep``
    (``doc_id, tk, copies``, unique), one row for each such key.

    Keys that ``keep`` marks with ``copies > 1`` name fully repeated rows;
    only those rows pass through a second, keyed reduction."""
    k = fresh(docs, "tk")
    d = docs.withColumn(k, text_key(F.col("text")))

    def part(which: DataFrame) -> DataFrame:
        w = which.select(F.col("doc_id").alias("_kid"), F.col("tk").alias("_ktk"))
        return d.join(w, d["doc_id"].eqNullSafe(w["_kid"]) & (d[k] == w["_ktk"]), "left_semi")

    once = part(keep.filter("copies = 1"))
    if keep.filter("copies > 1").isEmpty():
        return once.drop(k)
    return once.unionByName(part(keep.filter("copies > 1")).dropDuplicates(["doc_id", k])).drop(k)


def drop_keys(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``(doc_id, text_key)`` is not in ``bad``."""
    k = fresh(docs, "tk")
    d = docs.withColumn(k, text_key(F.col("text")))
    b = bad.select(F.col("doc_id").alias("_kid"), F.col("tk").alias("_ktk")).distinct()
    return d.join(b, d["doc_id"].eqNullSafe(b["_kid"]) & (d[k] == b["_ktk"]), "left_anti").drop(k)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
