"""Corpus pipeline: reject toxic documents, drop exact copies, drop near
copies, drop documents with benchmark passages, encode what is left.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read back as the next stage's ``docs``. All but the last
return the columns of ``docs`` unchanged; rows are only ever left out. Null and
empty texts, repeated rows, ties, extra columns and empty tables are handled as
the operators state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridwright.llm import bpe, decontaminate, exact_dedup, simhash_dedup, toxicity
from gridwright.llm.common import table, written
from gridwright.llm.queries import vocabulary


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.drop_near_copies(docs, shingle=3, max_bits=2)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(docs, vocabulary("word_bpe_49k.json")))


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("benchmark decontamination", benchmark),
          ("bpe", tokens)]

ORACLE_SQL = None  # a trained classifier and XXH64 fingerprints: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
