"""State of batch handlers: exact keep-first, compaction, repeated batches."""

import pytest
from pyspark.sql import functions as F

from gridwright import streaming
from gridwright.streaming.state import BatchTable


def batch(spark, rows):
    return spark.createDataFrame(rows, "k string, page_no int, row_no int, v string")


def kept(spark, sink):
    return {(r["k"], r["v"]) for r in spark.read.parquet(sink).collect()}


def test_first_to_arrive_stays_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    sink, state = str(tmp_path / "sink"), str(tmp_path / "state")
    handle = streaming.keep_first_batches(["k"], sink, state, buckets=4)
    handle(batch(spark, [("a", 2, 0, "a late"), ("a", 1, 9, "a first"), (None, 1, 0, "null key")]), 0)
    second = batch(spark, [("a", 0, 0, "too late"), ("b", 5, 1, "b second"), ("b", 5, 0, "b first"), (None, 0, 0, "too late")])
    want = {("a", "a first"), ("b", "b first")}  # a row without a key is left out
    for _ in range(3):  # a batch that failed after any of its steps runs again
        handle(second, 1)
        assert kept(spark, sink) == want
    handle(batch(spark, [("c", 0, 0, "c"), ("b", 0, 0, "no")]), 2)
    assert kept(spark, sink) == want | {("c", "c")}
    handle(batch(spark, []), 3)
    assert kept(spark, sink) == want | {("c", "c")}
    with pytest.raises(RuntimeError):
        handle(second, 0)


def test_a_batch_opens_only_its_own_buckets(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), partition_by=["key_bucket"])
    table.commit(0, spark.range(100).select(F.col("id").alias("k0"), (F.col("id") % 8).cast("int").alias("key_bucket")))
    plan = table.rows().filter("key_bucket in (3)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_bucket" in plan or "PartitionFilters: [(key_bucket" in plan


def test_compaction_bounds_what_a_reader_opens(spark, tmp_path):
    path, keys = str(tmp_path / "counts"), ["k"]
    handle = streaming.upsert_batches(path, keys, ["n"])
    table = streaming.counts_table(spark, path, keys, ["n"])
    now = {}
    for b in range(21):
        rows = [(f"k{b % 5}", b), ("all", b)]
        now.update(rows)
        for _ in range(2 if b % 8 in (0, 7) else 1):  # also repeats of batches that write a snapshot
            handle(spark.createDataFrame(rows, "k string, n int"), b)
        assert len(table.files()) <= table.every and len(table.batches()) <= 2
    assert {r["k"]: r["n"] for r in table.current().collect()} == now
    folders = [f.name for f in (tmp_path / "counts").iterdir() if f.is_dir()]
    assert len(folders) <= 2 * table.every


def test_a_batch_that_dies_before_its_marker_is_not_seen(spark, tmp_path, monkeypatch):
    table = BatchTable(spark, str(tmp_path / "t"))
    table.commit(0, spark.createDataFrame([("a", 1)], "k string, n int"))
    monkeypatch.setattr(BatchTable, "_clean", lambda self, b: None)
    table._store(spark.createDataFrame([("b", 2, 1)], "k string, n int, batch_id bigint"), "delta", 1)
    assert [r["k"] for r in table.current().collect()] == ["a"]
    table.commit(1, spark.createDataFrame([("c", 3)], "k string, n int"))
    assert sorted(r["k"] for r in table.current().collect()) == ["a", "c"]
