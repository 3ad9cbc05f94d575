"""Per-dataset contract, parametrized like the source's extractor contract
tests: every dataset extracts to its declared columns, reports a run row,
and turns a broken input into a failed run instead of an exception."""

import pytest
from pyspark.sql import functions as F

from gridwright.operators import bind
from gridwright.plans import export as ex
from gridwright.plans import standins
from gridwright.sources.grid import LANDING_KEYS

HEADERS = {
    "water_systems": bind.WATER_SYSTEM_HEADERS,
    "legal_entities": bind.LEGAL_ENTITY_HEADERS,
    "deficiency_types": bind.DEFICIENCY_TYPE_HEADERS + ["row_index"],
    "sample_schedules": bind.SAMPLE_SCHEDULE_HEADERS,
}


def landing(spark, sf, dataset):
    if dataset == "water_systems":
        return standins.water_system_grid(spark, sf)
    if dataset == "legal_entities":
        return standins.legal_entity_grid(spark, sf)
    if dataset == "deficiency_types":
        return standins.deficiency_rows(spark, sf)
    from gridwright.plans.catalog import _schedule_rows
    return _schedule_rows(spark, sf)


@pytest.mark.parametrize("dataset", sorted(HEADERS))
def test_extractor_contract(spark, sf_small, dataset):
    e = ex.extract(spark, ex.ExtractionQuery(dataset), landing(spark, sf_small, dataset))
    assert e.success and not e.errors
    assert e.records.columns == LANDING_KEYS + HEADERS[dataset]
    n = e.records.count()
    assert n > 0
    key = bind.KEY_COLUMN[dataset]
    if dataset != "deficiency_types":  # keep-first: keys are unique
        assert e.records.select(F.col(f"`{key}`")).distinct().count() == n
    runs = ex.run_batch(spark, [e]).collect()
    assert runs[0]["success"] and runs[0]["extracted_count"] == n and runs[0]["data_type"] == dataset


@pytest.mark.parametrize("dataset", sorted(HEADERS))
def test_extractor_failure_is_a_result(spark, dataset):
    e = ex.extract(spark, ex.ExtractionQuery(dataset), spark.range(2).withColumn("x", F.lit(1)))
    assert not e.success and e.errors
    runs = ex.run_batch(spark, [e]).collect()
    assert runs[0]["success"] is False and runs[0]["extracted_count"] == 0


def test_parallel_batch_keeps_order(spark, sf_small, tmp_path):
    exts = [ex.extract(spark, ex.ExtractionQuery(d), landing(spark, sf_small, d))
            for d in ("water_systems", "legal_entities", "deficiency_types")]
    dests = [str(tmp_path / f"d{i}") for i in range(3)]
    runs = ex.run_batch(spark, exts, dests, "json", max_parallel=3).orderBy("seq").collect()
    assert [r["data_type"] for r in runs] == ["water_systems", "legal_entities", "deficiency_types"]
    assert all(r["success"] for r in runs)
    assert spark.read.json(dests[0]).count() == runs[0]["extracted_count"]


def test_watermark_bounded_dedup(spark, tmp_path):
    import json
    import os
    import time
    from gridwright import streaming
    land = tmp_path / "land"
    land.mkdir()
    t0 = time.time() - 100
    batches = [[("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:10:00")],
               [("a", "2024-01-01 00:20:00"), ("c", "2024-01-01 00:30:00")]]
    for i, rows in enumerate(batches):
        f = land / f"p{i}.json"
        f.write_text("\n".join(json.dumps({"name": n, "captured_at": t}) for n, t in rows))
        os.utime(f, (t0 + 10 * i, t0 + 10 * i))
    schema = "name string, captured_at timestamp"
    out = streaming.ingest_pages(spark, str(land), schema, ["name"], str(tmp_path / "sink"),
                                 str(tmp_path / "ck"), event_time="captured_at", delay="1 hour",
                                 max_files_per_trigger=1)
    assert sorted(r["name"] for r in out.collect()) == ["a", "b", "c"]
