"""Export plans (PIP-*) and the event stream (STR-2, UDF-4)."""

import json
import os
import uuid

from pyspark.sql import functions as F

from gridwright.operators import dedup, filters
from gridwright.sinks import ordered
from gridwright.sources import grid
from gridwright import streaming
from gridwright.plans import export as ex
from gridwright.plans import standins
from gridwright.session import scratch_path


def test_extraction_query_rejects_unknown():
    import pytest
    with pytest.raises(ValueError):
        ex.ExtractionQuery("nope")
    cfg = ex.ExportConfiguration(("water_systems", "bogus"), "inspection", "csv")
    errs = cfg.check()
    assert any("bogus" in e for e in errs) and any("inspection" in e for e in errs)
    assert ex.ExportConfiguration(("water_systems",), "general", "tsv").check() == []


def test_extract_filters_and_failures(spark, sf_small):
    landing = standins.legal_entity_grid(spark, sf_small)
    q = ex.ExtractionQuery("legal_entities", {"exclusion_patterns": ["NATION_1", "(?P<n>x)"]})
    e = ex.extract(spark, q, landing)
    assert e.success and e.warnings and "(?P<n>x)" in e.warnings[0]
    names = [r["Individual Name"] for r in e.records.collect()]
    assert names and not any("NATION_1" in n for n in names)
    bad = ex.extract(spark, ex.ExtractionQuery("water_systems"), spark.range(3))
    assert not bad.success and "extraction failed" in bad.errors[0]
    paged = ex.extract(spark, ex.ExtractionQuery("water_systems", pagination=ex.PaginationConfig(10, 2, 2)),
                       standins.water_system_grid(spark, sf_small))
    assert paged.records.count() == 20


def test_general_export_with_failure_and_audit(spark, sf_small):
    run = scratch_path(spark, f"test-export-{uuid.uuid4().hex}")
    landings = {"water_systems": standins.water_system_grid(spark, sf_small),
                "legal_entities": spark.range(2),  # breaks: becomes a failed run, not an exception
                "deficiency_types": standins.deficiency_rows(spark, sf_small)}
    cfg = ex.ExportConfiguration(("water_systems", "legal_entities", "deficiency_types"), "general", "csv",
                                 output_path=run + "/export.csv")
    res = ex.export(spark, cfg, landings, events_path=run + "/events")
    assert res["completed"] and not res["all_success"]
    runs = {r["data_type"]: r for r in res["runs"].collect()}
    assert runs["water_systems"]["success"] and runs["water_systems"]["extracted_count"] > 0
    assert not runs["legal_entities"]["success"] and runs["legal_entities"]["errors"]
    assert runs["deficiency_types"]["source_info"]["batch_index"] == "2"
    written = spark.read.option("header", True).csv(res["paths"]["water_systems"])
    assert written.count() == runs["water_systems"]["extracted_count"]
    evs = [r["event_type"] for r in spark.read.parquet(run + "/events").orderBy("timestamp").collect()]
    assert evs == ["export_started", "export_completed"]


def test_inspection_export(spark, sf_small):
    run = scratch_path(spark, f"test-inspection-{uuid.uuid4().hex}")
    landings = {"water_systems": standins.water_system_grid(spark, sf_small),
                "deficiency_types": standins.deficiency_rows(spark, sf_small)}
    cfg = ex.ExportConfiguration(("deficiency_types", "water_systems"), "inspection", "json",
                                 output_path=run + "/report.json")
    res = ex.export(spark, cfg, landings)
    assert res["all_success"]
    folder = res["paths"]["inspection"]
    doc = json.loads("".join(open(f"{folder}/{f}").read() for f, _ in ordered.manifest(spark, folder)))
    assert list(doc) == ["water_systems", "deficiency_types"]
    assert set(doc["water_systems"][0]) == {"system_number", "system_name", "population", "county",
                                            "activity_status", "system_type"}
    bad = ex.export(spark, ex.ExportConfiguration(("water_systems",), "inspection", "csv"), landings)
    assert not bad["success"]
    none = ex.export(spark, ex.ExportConfiguration(("sample_schedules",), "inspection", "json", output_path=run + "/none.json"),
                     {"sample_schedules": standins.deficiency_rows(spark, sf_small).withColumn("dataset", F.lit("sample_schedules"))})
    assert not none["all_success"] and "nothing to write" in none["runs"].first()["errors"][0]
    assert not os.path.exists(run + "/none.json")


def test_event_stream_and_handlers(spark, tmp_path):
    src = tmp_path / "ev"
    src.mkdir()
    rows = [(1, "2024-01-01 10:00:00", "view"), (2, "2024-01-01 23:59:59", "view"), (3, "2024-01-02 00:00:00", "click")]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(src / "a"))
    out = streaming.event_counts(spark, str(src / "a"), str(tmp_path / "sink"), str(tmp_path / "ck"))
    got = {(str(r["window_start"]), r["event_type"]): r["n"] for r in out.collect()}
    assert got == {("2024-01-01 00:00:00", "view"): 2, ("2024-01-02 00:00:00", "click"): 1}
    seen = {}
    h = streaming.publish(None, {"view": lambda b, i: seen.setdefault("view", b.count())},
                          [lambda b, i: seen.setdefault("all", b.count())])
    h(df, 0)
    assert seen == {"view": 2, "all": 3}


def _page(capture, no, ids, at="2024-01-01T00:00:00Z"):
    rows = [[["A"], [i], [f"name {i}"], ["GW"], ["C"], ["NP"], ["10"], ["COUNTY"]] for i in ids]
    return json.dumps({"dataset": "water_systems", "capture_id": capture, "captured_at": at, "page_no": no, "total": "9", "values": rows})


def _captures(spark, tmp_path, lines):
    (tmp_path / "pages.json").write_text("\n".join(lines))
    return grid.read_captures(spark, str(tmp_path / "pages.json"))


def test_captures_are_read_apart(spark, tmp_path):
    raw = _captures(spark, tmp_path, [
        _page("a", 0, ["K1", "K2", "K3"]), _page("a", 1, []), _page("a", 2, ["K4", "K5", "K6"]),
        _page("b", 0, ["K1", "K2", "K3"]), _page("b", 1, ["K7", "K8"]), "{broken", _page("c", 0, ["K1", "K2", "K3"]),
        _page("c", 1, ["K3", "K2", "K1"]), _page("c", 2, ["K9", "K9", "K9"])])
    landing, pages, totals = grid.explode_rows(raw, captured_at="captured_at"), grid.page_list(raw), grid.reported_totals(raw)
    q = ex.ExtractionQuery("water_systems", pagination=ex.PaginationConfig(page_size=3))
    e = ex.extract(spark, q, landing, honor_stop=True, pages=pages, totals=totals)
    got = sorted((r["capture_id"], r["Water System No."]) for r in e.records.collect())
    # a stops at its empty page, b after its short page, c before its page without new keys
    assert got == [("a", k) for k in ("K1", "K2", "K3")] + [("b", k) for k in ("K1", "K2", "K3", "K7", "K8")] + [
        ("c", k) for k in ("K1", "K2", "K3")]
    assert e.total_available == 27
    every = ex.extract(spark, q, landing)
    assert every.records.count() == 6 + 5 + 4
    run = ex.run_batch(spark, [e]).first()
    assert run["total_available"] == 27 and "27" in run["warnings"][0]


def test_bad_lines_become_issues(spark, tmp_path):
    raw = _captures(spark, tmp_path, [_page("a", 0, ["K1"]), "{broken", "", '{"capture_id": "a", "page_no": 7}', _page("a", 1, [])])
    landing = grid.explode_rows(raw)
    assert ex.extract(spark, ex.ExtractionQuery("water_systems"), landing).records.count() == 1
    issues = {r["code"]: r for r in grid.capture_issues(spark, str(tmp_path / "pages.json")).collect()}
    assert set(issues) == {"BAD_JSON", "NO_VALUES", "EMPTY_PAGE"}
    assert issues["BAD_JSON"]["detail"] == "{broken" and issues["NO_VALUES"]["page_no"] == 7


def test_a_failing_export_says_so(spark, sf_small, tmp_path):
    cfg = ex.ExportConfiguration(("water_systems",), "inspection", "json", output_path="nosuchfs://x/report.json")
    res = ex.export(spark, cfg, {"water_systems": standins.water_system_grid(spark, sf_small)}, events_path=str(tmp_path / "ev"))
    assert not res["success"] and res["errors"]
    evs = [r["event_type"] for r in spark.read.parquet(str(tmp_path / "ev")).orderBy("timestamp").collect()]
    assert evs == ["export_started", "export_failed"]


def test_run_facts(spark, sf_small, tmp_path):
    cfg = ex.ExportConfiguration(("legal_entities", "deficiency_types"), "general", "csv", output_path=str(tmp_path / "o.csv"),
                                 filters={"legal_entities": {"exclusion_patterns": ["NATION_1"]},
                                          "deficiency_types": {"search_params": {"severity_code": "PROMO", "active_only": True}}},
                                 pagination=ex.PaginationConfig(5, 1, 1))
    res = ex.export(spark, cfg, {"legal_entities": standins.legal_entity_grid(spark, sf_small),
                                 "deficiency_types": standins.deficiency_rows(spark, sf_small)})
    runs = {r["data_type"]: r for r in res["runs"].collect()}
    assert runs["legal_entities"]["warnings"][0].startswith("Excluded ") and runs["legal_entities"]["pagination_info"]["page_size"] == "5"
    assert runs["legal_entities"]["extracted_count"] <= 5 and runs["deficiency_types"]["success"]


def test_search_and_union_types(spark):
    d = spark.createDataFrame([("A", 1), ("I", 2)], "Status string, n int")
    f = {"active_only": "Status", "count": "n"}
    assert filters.search(d, {"active_only": True}, f).count() == 1 and filters.search(d, {"active_only": False}, f).count() == 2
    assert filters.search(d, {"count": "2"}, f).count() == 1 and filters.search(d, {"count": "many"}, f).count() == 0
    both = dedup.combine_datasets({"a": d, "b": spark.createDataFrame([("x",)], "n string")})
    assert sorted(r["n"] for r in both.collect()) == ["1", "2", "x"]
    m = spark.sql("select 1 k, 2 page_no, 0 row_no, map('a', 1) r union all select 1, 1, 0, map('a', 2)")
    assert dedup.keep_first(m, ["k"]).first()["r"] == {"a": 2}


def test_exports_hold_no_landing_columns(spark, tmp_path):
    raw = _captures(spark, tmp_path, [_page("a", 0, ["K1", "K2", "K1"]), _page("a", 1, ["K3"])])
    landing = grid.explode_rows(raw, captured_at="captured_at")
    for fmt in ("csv", "tsv", "json"):
        cfg = ex.ExportConfiguration(("water_systems",), "general", fmt, output_path=str(tmp_path / f"out.{fmt}"),
                                     pagination=ex.PaginationConfig(2, 1, 1))
        res = ex.export(spark, cfg, {"water_systems": landing})
        path = res["paths"]["water_systems"]
        got = spark.read.json(path) if fmt == "json" else spark.read.option("sep", "\t" if fmt == "tsv" else ",").csv(path, header=True)
        assert set(got.columns) == set(ex.bind.WATER_SYSTEM_HEADERS) and got.count() == 2
        assert res["runs"].first()["pagination_info"]["pages"] == "2"


def test_failures_of_one_dataset_stay_its_own(spark, sf_small, tmp_path):
    good = standins.water_system_grid(spark, sf_small)
    broken = standins.deficiency_rows(spark, sf_small).withColumn("row_no", F.raise_error(F.lit("unreadable")).cast("bigint"))
    for mode, fmt in (("general", "csv"), ("inspection", "json")):
        cfg = ex.ExportConfiguration(("deficiency_types", "water_systems", "legal_entities"), mode, fmt, output_path=str(tmp_path / f"x.{fmt}"))
        res = ex.export(spark, cfg, {"water_systems": good, "deficiency_types": broken}, events_path=str(tmp_path / mode))
        runs = {r["data_type"]: r for r in res["runs"].collect()}
        assert runs["water_systems"]["success"] and runs["water_systems"]["extracted_count"] > 0
        assert "unreadable" in runs["deficiency_types"]["errors"][0] and not runs["deficiency_types"]["success"]
        assert "no landed pages" in runs["legal_entities"]["errors"][0]  # the landing that was never given
        done = spark.read.parquet(str(tmp_path / mode)).filter("event_type = 'export_completed'").first()
        assert done["context"]["failed"] == "deficiency_types,legal_entities" and res["completed"] and not res["all_success"]


def test_exclusions_are_counted_after_dedup_in_the_same_pass(spark, tmp_path):
    raw = spark.createDataFrame([(0, k, n) for k, n in enumerate(["SMITH, A", "SMITH, A", "JONES, B", "SMITHERS"])], "page_no int, row_no int, n string")
    landing = raw.select(F.lit("legal_entities").alias("dataset"), F.lit("c").alias("capture_id"), "page_no", "row_no",
                         F.array(F.array("n"), F.array(F.lit("IN"))).alias("cells"))
    e = ex.extract(spark, ex.ExtractionQuery("legal_entities", {"exclusion_patterns": ["^SMITH"]}), landing)
    run = ex.run_batch(spark, [e], [str(tmp_path / "o")]).first()
    assert run["extracted_count"] == 1 and run["warnings"] == ["Excluded 2 records by exclusion patterns"]
    assert run["pagination_info"] == {"pages": "1", "records": "1"}
    plain = ex.extract(spark, ex.ExtractionQuery("legal_entities"), landing)
    assert ex.run_batch(spark, [plain]).first()["warnings"] == [] and plain.facts.get == {"excluded": 0, "empty_names": 0}
    stops = ex.extract(spark, ex.ExtractionQuery("legal_entities", {"exclusion_patterns": ["^SMITH"]}), landing, honor_stop=True)
    assert ex.run_batch(spark, [stops]).first()["warnings"] == ["Excluded 2 records by exclusion patterns"]
