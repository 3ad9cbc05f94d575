"""Operators: keep-first semantics under skew, distributed positions, set
operations, paging, rules, migrations, and plan shape checks."""

import io
import contextlib

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.operators import aggregates as agg
from gridwright.operators import dedup, filters, migrate, paging, rules, windows


def plan_text(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_keep_first_hot_key(spark):
    # one key holds a third of all rows; the earliest (page_no, row_no) wins
    rows = [("HOT" if i % 3 == 0 else f"k{i}", i // 100, 999 - i % 100, f"v{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, page_no bigint, row_no bigint, val string").repartition(8)
    out = {r["key"]: r for r in dedup.keep_first(df, ["key"]).collect()}
    want = min((p, r, v) for k, p, r, v in rows if k == "HOT")
    assert (out["HOT"]["page_no"], out["HOT"]["row_no"], out["HOT"]["val"]) == want
    assert len(out) == 1 + sum(1 for i in range(3000) if i % 3)
    assert dedup.keep_first(df, ["key"]).columns == df.columns


def test_keep_first_drops_empty_keys_and_plans_partial_aggregate(spark):
    df = spark.createDataFrame([("", 0, 0), (None, 0, 1), ("a", 1, 0), ("a", 0, 5)],
                               "key string, page_no bigint, row_no bigint")
    out = dedup.keep_first(df, ["key"])
    p = plan_text(out)
    assert [tuple(r) for r in out.collect()] == [("a", 0, 5)]
    assert "partial_min" in p  # map-side combine before the shuffle
    assert p.count("Exchange hashpartitioning") == 1
    assert "PythonUDF" not in p and "BatchEvalPython" not in p


def test_global_index_equals_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id").alias("v")).repartition(5)
    got = {r["v"]: r["idx"] for r in windows.global_index(df, ["k"]).collect()}
    want = {r["v"]: r["rn"] - 1 for r in df.select("v", F.row_number().over(W.orderBy("k", "v")).alias("rn")).collect()}
    assert got == want


def test_global_index_hot_order_value(spark):
    # a third of the rows share one order value: positions stay exact and the
    # hot value is spread over several range partitions
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"),
                                     F.col("id").alias("v"))
    out = windows.global_index(df, ["k"], num_partitions=6)
    got = {r["v"]: r["idx"] for r in out.collect()}
    want = {r["v"]: r["rn"] - 1 for r in df.select("v", F.row_number().over(W.orderBy("k", "v")).alias("rn")).collect()}
    assert got == want
    parts = df.repartitionByRange(6, "k", "v").where(F.col("k") == 7) \
        .select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


def test_running_sum_equals_window(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("o"), (F.col("id") % 13).alias("n"),
                                     (F.col("id") % 2).alias("g"))
    got = {(r["g"], r["o"]): r["cum"] for r in windows.running_sum(df, "n", "o", partition=["g"], bucket_size=100).collect()}
    w = W.partitionBy("g").orderBy("o").rowsBetween(W.unboundedPreceding, -1)
    want = {(r["g"], r["o"]): r["c"] or 0 for r in df.select("g", "o", F.sum("n").over(w).alias("c")).collect()}
    assert got == want


def test_running_sum_sparse_keys(spark):
    # sparse order keys (gaps of 10^9): buckets stay few, sums stay exact
    df = spark.range(0, 2000).select((F.col("id") * 1_000_000_007).alias("o"), (F.col("id") % 7).alias("n"))
    out = windows.running_sum(df, "n", "o", bucket_size=16, max_buckets=50)
    got = {r["o"]: r["cum"] for r in out.collect()}
    w = W.orderBy("o").rowsBetween(W.unboundedPreceding, -1)
    want = {r["o"]: r["c"] or 0 for r in df.select("o", F.sum("n").over(w).alias("c")).collect()}
    assert got == want


def test_progress_divides_first(spark):
    df = spark.createDataFrame([(0, 29), (1, 71)], "b bigint, n bigint")
    out = {r["b"]: r["progress_pct"] for r in windows.progress(df, "n", "b", F.lit(100)).collect()}
    assert out == {0: 0, 1: int(29 / 100 * 100)}  # 28 in double arithmetic


def test_stop_rules(spark):
    stats = spark.createDataFrame([("c", 0, 1000, 10), ("c", 1, 1000, 0), ("c", 2, 1000, 5),
                                   ("d", 0, 1000, 3), ("d", 1, 40, 1), ("d", 2, 1000, 9),
                                   ("e", 0, 1000, 1)], "capture_id string, page_no bigint, n_valid bigint, n_new bigint")
    stops = {r[0]: r[1] for r in windows.stop_page(stats).collect()}
    assert stops == {"c": 0, "d": 1, "e": None}


def test_stalled_pages(spark):
    pages = spark.createDataFrame([("c", 0, 10, "a"), ("c", 1, 10, "a"), ("c", 2, 10, "b"), ("c", 3, 9, "b")],
                                  "capture_id string, page_no bigint, n_rows bigint, first_key string")
    got = {r["page_no"]: r["changed"] for r in windows.stalled_pages(pages).collect()}
    assert got == {0: None, 1: False, 2: True, 3: True}


def test_set_operations(spark):
    a = spark.createDataFrame([(3,), (1,), (2,), (2,)], "x int")
    b = spark.createDataFrame([(2,), (3,), (4,)], "x int")
    assert [r[0] for r in dedup.intersect_sorted(a, b).collect()] == [2, 3]
    assert sorted(r[0] for r in dedup.difference(a, b).collect()) == [1]
    u = dedup.combine_datasets({"one": spark.createDataFrame([(1, "a")], "k int, n string"),
                                "two": spark.createDataFrame([(2, 5.0)], "k int, z double")})
    assert u.columns == ["data_type", "k", "n", "z"]
    assert dedup.sorted_column_union([a, u]) == ["data_type", "k", "n", "x", "z"]
    ev = spark.createDataFrame([("b", 5), ("a", 7), ("b", 1), ("c", 3)], "v string, s int")
    assert [tuple(r) for r in dedup.ordered_distinct(ev, "v", "s").collect()] == [("b", 1), ("c", 3), ("a", 7)]


def test_patterns_and_search(spark):
    chk = filters.check_patterns(spark, [".*ADDRESS.*", r"^[A-Z]{2}\d+$", "(", "(?P<n>x)"])
    assert [c.valid for c in chk] == [True, True, False, False]
    df = spark.createDataFrame([("MS123",), ("123 ADDRESS LN",), ("SMITH, JOHN",), (None,)], "n string")
    kept = [r[0] for r in filters.exclude_patterns(df, "n", [".*ADDRESS.*", r"^[A-Z]{2}\d+$"]).collect()]
    assert kept == ["SMITH, JOHN", None]  # a NULL name is kept
    assert filters.exclude_patterns(df, "n", []).count() == 4
    s = spark.createDataFrame([("0100001", "OT", True), ("0100002", "TC", False)], "`PWS ID` string, t string, a boolean")
    out = filters.search(s, {"pws_id": "0100001", "bogus": 1, "t": None}, {"pws_id": "PWS ID"})
    assert out.count() == 1


def test_lookup_and_membership(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    got = [r[0] for r in filters.lookup_or_self(df, "k", {"a": "A"}).collect()]
    assert got == ["A", "b", None]
    table = spark.createDataFrame([("b", "B")], "key string, value string")
    got = sorted((r[0] or "") for r in filters.lookup_join(df, "k", table, "key", "value").collect())
    assert got == ["", "B", "a"]
    hot = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit("b")).otherwise(
        F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
    for kw in ({"salt_buckets": 8}, {}):
        res = filters.lookup_join(hot, "k", table, "key", "value", **kw)
        assert res.count() == 3000 and res.filter(F.col("k") == "B").count() == 1000
    allowed = spark.createDataFrame([("a",)], "k string")
    for a in (allowed, ["a"]):
        assert [r[0] for r in filters.semi(df, a, ["k"]).collect()] == ["a"]
        assert sorted((r[0] or "") for r in filters.anti(df, a, ["k"]).collect()) == ["", "b"]


def test_paging(spark):
    df = spark.range(0, 23).select(F.col("id").alias("k"))
    page = paging.offset_page(df, ["k"], page_size=5, start_page=2, max_pages=2).orderBy("k").collect()
    assert [r["k"] for r in page] == list(range(5, 15))
    assert [r["page_no"] for r in page][:1] == [2] and page[-1]["row_in_page"] == 5
    # inclusive keyset searches of 5: rows 0-4, then 4-8 (4 repeated), 8-12, ...
    scan = {r["k"]: r["search_no"] for r in paging.keyset_scan(df, "k", page_size=5).collect()}
    model, last, search = {}, None, 0
    while len(model) < 23:
        page = [k for k in range(23) if last is None or k >= last][:5]
        for k in page:
            model.setdefault(k, search)
        last, search = page[-1], search + 1
    assert scan == model
    ks = paging.keyset_page(df, "k", 20, page_size=1000).collect()
    assert [r[0] for r in ks] == [20, 21, 22]
    v = spark.createDataFrame([("s", "1.9.0"), ("s", "1.10.0"), ("t", "2.0.0")], "schema_name string, version string")
    assert dict(paging.latest_version(v, default=None).collect()) == {"s": "1.10.0", "t": "2.0.0"}
    ev = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 4)], "data_type string, id int")
    assert paging.preview(ev, 2, order=["id"]).count() == 3


def test_rules_engine(spark):
    cfg = spark.createDataFrame([
        (1, "testuser", "testpass123", "http://records:8080/APP/", "1000"),
        (2, "", "", "invalid-url", "not-a-number"),
        (3, "test@user", "123", "http://localhost/x", "20000"),
    ], "id int, username string, password string, base_url string, batch_size string")
    rs = [rules.required("username", "MISSING_CREDENTIAL", allow_empty=False),
          rules.required("password", "MISSING_CREDENTIAL", allow_empty=False),
          rules.min_length("username", 2, "INVALID_USERNAME_LENGTH"),
          rules.matches("username", "^[a-zA-Z0-9_.-]+$", "INVALID_USERNAME_FORMAT"),
          rules.not_in("password", ["password", "123456", "admin"]),
          *rules.url_rules("base_url", path_suffix="/APP"),
          *rules.int_tiers("batch_size", 1, [(10000, "Batch size %d is very large"), (5000, "Batch size %d is large")])]
    issues = rules.validate(cfg, rs, ["id"])
    got = {(r["id"], r["code"] or r["rule"]) for r in issues.collect()}
    assert (1, "url_path:base_url") not in got and not any(i == 1 for i, _ in got)
    for code in ["MISSING_CREDENTIAL", "MISSING_PROTOCOL", "MISSING_HOSTNAME", "INVALID_PROTOCOL",
                 "INVALID_BATCH_SIZE_FORMAT"]:
        assert (2, code) in got, code
    assert (3, "INVALID_USERNAME_FORMAT") in got and (3, "url_localhost:base_url") in got
    assert (3, "above:batch_size:10000") in got and (3, "above:batch_size:5000") not in got
    summ = rules.issue_summary(issues, ["id"]).collect()
    assert {r["id"]: r["valid"] for r in summ} == {2: False, 3: False}
    # counting straight from the predicates gives the same totals
    direct = rules.sum_counts([rules.count_issues(cfg, rs)]).first().asDict()
    via_rows = rules.issue_summary(issues).first().asDict()
    assert direct == via_rows


def test_rule_runner_turns_failures_into_issues(spark):
    df = spark.createDataFrame([(1, 5)], "id int, v int")
    out = rules.run_rules(df, [rules.required("v")], ["id"], {"broken": lambda d: d.select("nope")})
    rows = out.collect()
    assert len(rows) == 1 and rows[0]["code"] == "RULE_EXECUTION_ERROR"


def test_config_rules(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "old": 2}'), (2, '{"a": "x"}'), (3, '{"b": true}')], "id int, j string")
    rs = rules.config_rules("j", required_keys=["a"], deprecated=["old"],
                            properties={"a": {"type": "integer"}, "b": {"type": "number"}}, version="1.1.0")
    got = sorted((r["id"], r["rule"]) for r in rules.validate(df, rs, ["id"]).collect())
    assert got == [(1, "config_deprecated:old"), (2, "config_type:a"), (3, "config_required:a")]


def test_migrations(spark):
    m = migrate.Migrator()
    m.register("s", "1", "2", lambda d: d.withColumn("b", F.lit(2)))
    m.register("s", "2", "3", lambda d: d.withColumn("c", F.lit(3)))
    m.register("s", "3", "4", lambda d: d.withColumn("d", F.lit(4)))
    df = spark.range(1)
    assert m.path("s", "1", "4") == [("1", "2"), ("2", "3"), ("3", "4")]
    assert m.migrate(df, "s", "1", "4").columns == ["id", "b", "c", "d"]
    with pytest.raises(migrate.MigrationError):
        m.path("s", "4", "1")
    with pytest.raises(migrate.MigrationError):
        m.path("other", "1", "2")
    typed = migrate.default_migrator().migrate(spark.range(1).withColumn("validation_level", F.lit("strict")),
                                               "export_configuration", "1.0.0", "1.1.0").first()
    assert typed["validation_level"] == "strict" and typed["file_naming_policy"]["include_timestamp"] is True


def test_aggregates(spark):
    runs = spark.createDataFrame([
        ("water_systems", 1, 10, 1.5, True, 12, ["e1"]), ("legal_entities", 0, 5, 0.5, False, None, ["e0", "e00"])],
        "data_type string, seq int, extracted_count bigint, extraction_time double, success boolean, "
        "total_available bigint, errors array<string>")
    one = runs.agg(*[c.alias(k) for k, c in agg.batch_summary_exprs().items()]).first()
    assert one["errors"] == ["e0", "e00", "e1"] and one["data_types"] == ["legal_entities", "water_systems"]
    assert one["total_available"] == 12 and one["all_success"] is False and one["n_failed"] == 1
    cov = spark.createDataFrame([(10, 10), (9, 10), (11, 10), (1, 0), (1, None), (1, 3)], "e bigint, t bigint")
    got = [tuple(r) for r in cov.select(agg.coverage("e", "t").alias("c")).select("c.*").collect()]
    assert got == [(100.0, "complete"), (90.0, "missing 1"), (110.0, "extra 1"), (None, None), (None, None),
                   (33.3, "missing 2")]
    s = spark.range(1).select(agg.numbered_summary(F.array(F.lit("Invalid a: x")), F.array(F.lit("w")))).first()[0]
    assert s == "Found 1 validation error(s):\n  1. Invalid a: x\n\nWarnings (1):\n  1. w"


def test_small_helpers(spark):
    from gridwright import functions as G
    from gridwright.operators import project
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    r = spark.sql("select map('a', '1', 'b', '2') m1, map('b', '9') m2, 150 p, -3 q, "
                  "timestamp_ntz'2024-05-06 07:08:09' t").select(
        G.merge_maps("m1", "m2").alias("m"), G.clamp_percent("p").alias("p"), G.clamp_percent("q").alias("q"),
        G.stamp("t").alias("s"), G.row_json(F.lit(None).cast("string").alias("x")).alias("j")).first()
    assert r["m"] == {"a": "1", "b": "9"} and (r["p"], r["q"]) == (100, 0)
    assert r["s"] == "20240506_070809" and r["j"] == '{"x":null}'
    df = spark.createDataFrame([("1", "n", "x")], "system_number string, name string, other string")
    assert project.subset_for_mode(df, "water_systems").columns == ["system_number", "name"]
    runs = spark.createDataFrame([(0, True), (1, False), (2, None)], "batch_index int, success boolean")
    ok, bad = filters.split_outcomes(runs)
    assert ok.count() == 1 and bad.count() == 2
    paths = spark.createDataFrame([(0, "a.csv"), (1, "b.csv")], "batch_index int, path string")
    assert filters.zip_by_position(runs, paths).count() == 2
    prov = project.enrich_provenance(spark.range(1), {"batch_index": F.lit(3), "extractor": "landed"})
    assert prov.first()["source_info"] == {"batch_index": "3", "extractor": "landed"}


def test_extract_with_stop_rules(spark, sf_small):
    from gridwright.plans import export as ex
    from gridwright.plans import standins
    landing = standins.water_system_grid(spark, sf_small)
    all_rows = ex.extract(spark, ex.ExtractionQuery("water_systems"), landing).records
    stopped = ex.extract(spark, ex.ExtractionQuery("water_systems"), landing, honor_stop=True).records
    # sf0.001 has one short first page: the read stops after it, so the
    # re-served copies on page 1 (all duplicates) cannot add rows
    assert stopped.count() == all_rows.filter(F.col("page_no") == 0).count()


def test_custom_transform_and_events(spark):
    from gridwright import functions as G
    from gridwright.operators import events, project
    from gridwright.sources.schema_files import FieldRule
    G.register_transform("title", G.title_label)
    assert "title" in G.known_transforms()
    df = spark.createDataFrame([("water_systems",), (None,)], "t string")
    got = [r[0] for r in project.project(df, [FieldRule("t", "label", transform="title")]).collect()]
    assert got == ["Water Systems", None]
    ev = spark.createDataFrame([
        (3, "2024-01-01 00:00:03", "export_completed", "x1", "info"),
        (1, "2024-01-01 00:00:05", "export_started", "x1", "info"),
        (2, "2024-01-01 00:00:01", "export_failed", "x2", "error")],
        "event_id long, timestamp string, event_type string, aggregate_id string, severity string") \
        .withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    f = events.filter_events(ev, aggregate_id="x1", after="2024-01-01 00:00:03")
    assert [r["event_id"] for r in f.collect()] == [1]
    st = events.event_statistics(ev).first()
    assert st["total_events"] == 3
    assert str(st["first_event_timestamp"]) == "2024-01-01 00:00:05"  # insertion order, not min
    assert str(st["last_event_timestamp"]) == "2024-01-01 00:00:03"
    assert st["event_type_counts"] == {"export_completed": 1, "export_failed": 1, "export_started": 1}
    assert st["severity_counts"] == {"error": 1, "info": 2}


def test_global_index_without_exchange_reuse(spark):
    """Positions must not rest on two plans of the same ranges agreeing."""
    from gridwright.operators import paging, windows
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(300_000).select((F.col("id") * 7919 % 300_007).alias("k"), F.lit("x").alias("odd name"),
                                         F.create_map(F.lit("a"), F.col("id")).alias("m"))
        got = windows.global_index(df, ["k"], num_partitions=13)
        r = got.agg(F.countDistinct("idx").alias("n"), F.min("idx").alias("a"), F.max("idx").alias("b")).first()
        assert (r["n"], r["a"], r["b"]) == (300_000, 0, 299_999) and got.columns == ["k", "odd name", "m", "idx"]
        low = got.filter("idx < 5").orderBy("idx").collect()
        assert [x["k"] for x in low] == sorted(x["k"] for x in df.select("k").orderBy("k").limit(5).collect())
        page = paging.offset_page(df.select("k"), ["k"], 10, start_page=3, max_pages=2).collect()
        assert [(x["page_no"], x["row_in_page"]) for x in sorted(page, key=lambda x: x["k"])] == [
            (3 + i // 10, i % 10 + 1) for i in range(20)]
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_each_predicate_stands_once_in_the_plan(spark):
    d = spark.range(50).select(F.col("id"), (F.col("id") * 3).alias("v"))
    rs = [rules.Rule(f"r{k}", "v", F.col("v") % (1000 + k) == 7, message=F.format_string("v=%d", F.col("v"))) for k in range(70)]
    plan = rules.validate(d, rs, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(f"% {1000 + k})") == 1 for k in (0, 33, 61, 62, 69))


def test_more_rules_than_bits(spark):
    d = spark.createDataFrame([(1, 5), (2, None), (3, 69), (4, 62)], "id int, v int")
    rs = [rules.Rule(f"is_{k}", "v", F.col("v") == k, message=f"text {k}" if k % 2 else F.concat(F.lit("col "), F.col("v").cast("string")))
          for k in range(70)]
    got = {(r["id"], r["rule"], r["value"], r["message"]) for r in rules.validate(d, rs, ["id"]).collect()}
    assert got == {(1, "is_5", "5", "text 5"), (3, "is_69", "69", "text 69"), (4, "is_62", "62", "col 62")}
    both = rules.validate(d, [rules.Rule("a", "v", F.col("v") > 0), rules.Rule("b", "v", F.col("v").isNull()), rules.Rule("c", "v", F.col("v") > 60)], ["id"])
    assert sorted((r["id"], r["rule"]) for r in both.collect()) == [(1, "a"), (2, "b"), (3, "a"), (3, "c"), (4, "a"), (4, "c")]


def test_a_rule_that_fails_while_it_runs_is_an_issue(spark):
    d = spark.createDataFrame([(1, ""), (2, "x")], "id int, v string")
    bad = F.when(F.col("id") > 0, F.raise_error(F.lit("boom"))).isNotNull()
    out = rules.run_rules(d, [rules.Rule("bad", "v", bad), rules.required("v", allow_empty=False)], ["id"],
                          {"late": lambda x: rules.validate(x.filter(bad), [rules.required("v")], ["id"])}).collect()
    assert sorted((r["id"] or 0, r["rule"], r["code"]) for r in out) == [
        (0, "bad", "RULE_EXECUTION_ERROR"), (0, "late", "RULE_EXECUTION_ERROR"), (1, "required:v", "MISSING_REQUIRED")]
    assert all("boom" in r["message"] for r in out if r["code"] == "RULE_EXECUTION_ERROR")


def test_dense_keys_are_spread_over_ranges(spark):
    d = spark.range(20_000).select(F.when(F.col("id") == 0, F.lit(10**15)).otherwise(F.col("id")).alias("o"), F.lit(1).alias("n"))
    stored, _ = windows.stored_ranges(d, [F.col("o")], 8)
    sizes = [r["count"] for r in stored.groupBy("_gi_pid").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    got = {r["o"]: r["cum"] for r in windows.running_sum(d, "n", "o").collect()}
    assert got[1] == 0 and got[19_999] == 19_998 and got[10**15] == 19_999
    grouped = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 5)], "g string, o int, n int")
    assert sorted((r["g"] or "", r["o"], r["cum"]) for r in windows.running_sum(grouped, "n", "o", partition=["g"]).collect()) == [
        ("", 1, 0), ("", 2, 2), ("a", 1, 0)]


def test_deep_window_opens_only_its_ranges(spark):
    d = spark.range(10_000).select((F.col("id") % 97).alias("k"), "id")
    index = paging.PageIndex(d, ["k"], 16)
    want = windows.global_index(d, ["k"], out="_pos")
    for first, n in ((0, 5), (4_321, 50), (9_990, 50), (20_000, 5), (2_000, None)):
        got = {(r["k"], r["id"], r["_pos"]) for r in index.rows(first, n).collect()}
        end = 10_000 if n is None else first + n
        assert got == {(r["k"], r["id"], r["_pos"]) for r in want.filter((F.col("_pos") >= first) & (F.col("_pos") < end)).collect()}
    assert len(index.rows(4_321, 50).inputFiles()) >= 1
    files = index.rows(4_321, 50).select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 2
    scan = index.rows(4_321, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "_gi_pid" in scan.split("PartitionFilters")[1][:80]
    top = paging.offset_page(d, ["k"], 10, 7, 3)
    deep = paging.offset_page(d, ["k"], 10, 7, 3, top_rows=0)
    shared = paging.offset_page(d, ["k"], 10, 7, 3, index=index)
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, deep.collect())) == sorted(map(tuple, shared.collect()))


def test_a_policy_of_its_own_is_kept_whole(spark):
    d = spark.createDataFrame([(1, '{"file_naming_policy": {"include_timestamp": false, "prefix": "x", "deep": {"a": [1]}}}'), (2, "{}")], "id int, config string")
    out = migrate.export_config_v1_to_v1_1_json("config")(d).select("id", F.to_json("file_naming_policy_all").alias("j"), "file_naming_policy").collect()
    import json
    got = {r["id"]: json.loads(r["j"]) for r in out}
    assert got[1] == {"include_timestamp": False, "prefix": "x", "deep": {"a": [1]}}
    assert set(got[2]) == {"include_timestamp", "timestamp_format", "include_data_type"}
