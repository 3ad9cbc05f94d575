"""More registered queries: what runs write and report, failing rules, deep
windows, presets and small functions (``catalog.query`` registers them)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import digits_or_null, exact_integer, fmt, register_transform
from ..functions.text import title_label
from ..operators import aggregates as agg
from ..operators import bind, dedup, filters, paging, project, rules, windows
from ..session import scratch_path, table
from ..sinks import RUNS_SCHEMA, append_runs, read_csv, read_ordered, write_csv_with_preamble
from ..sources import grid
from ..sources.html import bind_header, html_rows
from ..sources.schema_files import FieldRule, load_schema
from . import export as ex
from . import standins
from .catalog import DEF_SQL, LE_DEDUP_SQL, LE_SQL, WS_DEDUP_SQL, legal_entities, query, ws_dedup


# Rules that fail while they run (VAL-14, UDF-2): one built-in, one custom;
# the others still give their issues.

@query("rule_failures", """
SELECT c_custkey, 'min_length:c_name' AS rule, 'error' AS severity, 'TOO_SHORT' AS code FROM customer WHERE length(c_name) < 19
UNION ALL SELECT c_custkey, 'own_rule', 'warning', 'NEGATIVE' FROM customer WHERE c_acctbal < 0
UNION ALL SELECT NULL, 'broken_builtin', 'error', 'RULE_EXECUTION_ERROR'
UNION ALL SELECT NULL, 'broken_custom', 'error', 'RULE_EXECUTION_ERROR'""")
def q_rule_failures(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    fail = F.when(F.col("c_custkey") > 0, F.raise_error(F.lit("unreadable row"))).isNotNull()

    def own(d):
        issue = [F.lit(v).cast("string").alias(f) for f, v in zip(rules.ISSUE_FIELDS, (
            "own_rule", "c_acctbal", None, "warning", "NEGATIVE", "a negative balance", None))]
        return d.filter("c_acctbal < 0").select("c_custkey", *issue)

    out = rules.run_rules(c, [rules.min_length("c_name", 19, code="TOO_SHORT"), rules.Rule("broken_builtin", "c_name", fail)], ["c_custkey"],
                          {"own_rule": own, "broken_custom": lambda d: own(d.filter(fail))})
    return out.select("c_custkey", "rule", "severity", "code")


@query("deep_page", """
SELECT o_orderkey, o_custkey, CAST(pos // 37 + 1 AS BIGINT) AS page_no, CAST(pos % 37 + 1 AS BIGINT) AS row_in_page
FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) - 1 AS pos FROM orders)
WHERE pos >= 37 * 19 AND pos < 37 * 24""")
def q_deep_page(spark, sf):
    """SRT-2 beyond the top-k: the window opens the ranges that hold it."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (-F.col("o_custkey")).alias("rank"))
    return paging.offset_page(o, ["rank", "o_orderkey"], 37, 20, 5, top_rows=0).drop("rank")


@query("dense_running_sum", """
SELECT o_orderkey, CAST(coalesce(sum(o_custkey) OVER (ORDER BY CASE WHEN o_orderkey % 500 = 0 THEN o_orderkey * 1000000000 ELSE o_orderkey END
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum FROM orders""")
def q_dense_running_sum(spark, sf):
    """WIN-2 with nearly all keys in one narrow range."""
    key = F.when(F.col("o_orderkey") % 500 == 0, F.col("o_orderkey") * 1_000_000_000).otherwise(F.col("o_orderkey"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", key.alias("key"))
    return windows.running_sum(o, "o_custkey", "key").select("o_orderkey", F.col("cum").cast("bigint").alias("cum"))


# Legal entities as captured pages, with the total in a field of its own (SRC-2, SRC-9).

@query("entity_captures", f"""
SELECT page_no, "Individual Name", "Organization", "ID Number", (SELECT count(*) FROM supplier) AS total FROM ({LE_SQL}) e""")
def q_entity_captures(spark, sf):
    g = standins.legal_entity_grid(spark, sf)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x["cells"])
    total = table(spark, sf, "supplier").agg(F.count(F.lit(1)).cast("string")).scalar()
    pages = g.groupBy("dataset", "capture_id", "page_no").agg(rows.alias("values")).withColumn("Field1", F.concat(F.lit(" "), total, F.lit(" ")))
    path = scratch_path(spark, f"captures-{uuid.uuid4().hex}")
    pages.select(F.to_json(F.struct("*"))).write.text(path)
    raw = grid.read_captures(spark, path)
    bound = bind.bind_legal_entities(grid.to_strict(grid.explode_rows(raw)))
    seen = grid.reported_totals(raw, field="Field1").select("capture_id", F.col("total_available").alias("total"))
    return bound.join(seen, "capture_id").select("page_no", "`Individual Name`", "Organization", "`ID Number`", "total")


@query("preamble_lines", """
SELECT row_number() OVER (ORDER BY part, k) - 1 AS pos, line FROM (
  SELECT 0 AS part, 0 AS k, 'Data Type,water_systems' AS line UNION ALL SELECT 0, 1, 'Extracted Count,' || count(*) FROM customer
  UNION ALL SELECT 0, 2, 'Extraction Time,1.50 seconds' UNION ALL SELECT 0, 3, 'Timestamp,2024-01-02T03:04:05'
  UNION ALL SELECT 0, 4, 'Export Mode,general' UNION ALL SELECT 1, 0, '' UNION ALL SELECT 2, 0, 'c_custkey,"name, full",c_mktsegment'
  UNION ALL SELECT 3, c_custkey, c_custkey || ',"' || c_name || ', x",' || c_mktsegment FROM customer) t""")
def q_preamble_lines(spark, sf):
    """SNK-3: the written text, line by line."""
    c = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(", x")).alias("name, full"), "c_mktsegment").orderBy("c_custkey")
    run = spark.createDataFrame([("r", 0, "water_systems", True, c.count(), 1.5, None, None, {}, {}, [], [])], RUNS_SCHEMA) \
        .withColumn("extraction_timestamp", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    path = scratch_path(spark, f"preamble-{uuid.uuid4().hex}")
    write_csv_with_preamble(c, run, path, "general")
    return windows.global_index(read_ordered(spark, path), ["section", "piece", "block", "at"], out="pos").select("pos", "line")


@query("text_functions", """
SELECT event_id, upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' Rate 2X' AS label,
       CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.50s' AS took, strftime(ts, '%Y%m%d_%H%M%S') AS stamp,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microsecond', ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END AS iso,
       CASE event_id % 3 WHEN 0 THEN 'invalid_format' WHEN 1 THEN 'write_failure' ELSE 'export_failure' END AS failure,
       least(greatest(CAST(event_id % 150 - 20 AS BIGINT), 0), 100) AS pct, 'new' || event_type AS merged
FROM events""")
def q_text_functions(spark, sf):
    """FN-13, FN-15, FN-16, FN-20, FN-23, FN-24."""
    e, k = table(spark, sf, "events"), F.col("event_id") % 3
    kind = F.when(k == 0, F.lit("ValueError")).when(k == 1, F.lit("PermissionError")).otherwise(F.lit("KeyError"))
    message = F.when(k == 0, F.lit("Bad FORMAT given")).otherwise(F.lit("no"))
    merged = fmt.merge_maps(F.create_map(F.lit("a"), F.lit("old")), F.create_map(F.lit("a"), F.concat(F.lit("new"), "event_type")))
    return e.select("event_id", title_label(F.concat("event_type", F.lit("_rate_2x"))).alias("label"),
                    fmt.duration_text(F.floor("value") + 0.5).alias("took"), fmt.stamp("ts").alias("stamp"), fmt.iso_timestamp("ts").alias("iso"),
                    fmt.classify_output_error(kind, message).alias("failure"),
                    fmt.clamp_percent((F.col("event_id") % 150 - 20).cast("bigint")).alias("pct"), merged["a"].alias("merged"))


@query("mode_fields", f"""
SELECT "Water System No." AS system_number, "Name" AS name, "Activity Status" AS activity_status, "Population" AS population
FROM ({WS_DEDUP_SQL}) d""")
def q_mode_fields(spark, sf):
    """PRJ-14, PRJ-15."""
    return project.subset_for_mode(project.rename_for_mode(ws_dedup(spark, sf), "water_systems", "inspection"), "water_systems")


@query("run_outcomes", """
WITH r AS (SELECT event_type AS data_type, event_id % 100 AS n, event_id % 997 <> 3 AS ok FROM events)
SELECT 'summary' AS kind, data_type AS name, CAST(sum(n) AS BIGINT) AS n, bool_and(ok) AS ok, CAST(count(*) * 0.5 AS DOUBLE) AS seconds FROM r GROUP BY data_type
UNION ALL SELECT 'failed', 'all', CAST(count(*) AS BIGINT), false, NULL FROM r WHERE NOT ok
UNION ALL SELECT 'paired', 'out/' || (event_id % 10) || '.csv', CAST(count(*) AS BIGINT), true, NULL FROM events WHERE event_id % 997 <> 3 GROUP BY event_id % 10""")
def q_run_outcomes(spark, sf):
    """AGG-1, AGG-4, FLT-11, JON-4 over one run row per event."""
    runs = table(spark, sf, "events").select(F.col("event_type").alias("data_type"), (F.col("event_id") % 100).alias("extracted_count"),
                                             F.lit(0.5).alias("extraction_time"), (F.col("event_id") % 997 != 3).alias("success"),
                                             (F.col("event_id") % 10).alias("batch_index"))
    good, bad = filters.split_outcomes(runs)
    summary = agg.per_dataset_summary(runs).select(F.lit("summary").alias("kind"), F.col("data_type").alias("name"), F.col("extracted_count").alias("n"),
                                                   F.col("success").alias("ok"), F.col("extraction_time").alias("seconds"))
    failed = agg.count_rows(bad, "n").select(F.lit("failed").alias("kind"), F.lit("all").alias("name"), "n", F.lit(False).alias("ok"))
    paths = good.select("batch_index").distinct().withColumn("path", F.concat(F.lit("out/"), "batch_index", F.lit(".csv")))
    paired = filters.zip_by_position(good, paths).groupBy(F.col("path").alias("name")).agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit("paired").alias("kind"), "name", "n", F.lit(True).alias("ok"))
    return dedup.union_by_name([summary, failed, paired])


@query("selected_union", """
SELECT 'supplier' AS data_type, s_suppkey AS key, s_name AS name, NULL AS segment FROM supplier
UNION ALL SELECT 'customer', c_custkey, c_name, c_mktsegment FROM customer""")
def q_selected_union(spark, sf):
    """SET-4, SET-8, PRJ-8: chosen datasets, columns by sorted name."""
    c = table(spark, sf, "customer").selectExpr("c_custkey as key", "c_name as name", "c_mktsegment as segment")
    s = table(spark, sf, "supplier").selectExpr("s_suppkey as key", "s_name as name")
    p = table(spark, sf, "part").selectExpr("p_partkey as key")
    both = dedup.combine_datasets({"part": p, "customer": c, "supplier": s}, selected=["supplier", "absent", "customer"])
    return both.select(*dedup.sorted_column_union([both]))


@query("blank_table_rows", """
SELECT c_custkey AS page_id, 1 AS row_index, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 3, c_phone_like, '' FROM (SELECT c_custkey, 'P' || c_custkey AS c_phone_like FROM customer)""")
def q_blank_table_rows(spark, sf):
    """FLT-12: table rows whose cells are all empty are left out."""
    td = lambda *cs: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cs], F.lit("</tr>"))
    blank = F.lit(" ")
    first = F.when(F.col("c_custkey") % 3 == 0, td(blank, blank)).otherwise(td(F.col("c_name"), F.col("c_mktsegment")))
    html = F.concat(F.lit("<table><tr><th>Name</th><th>Segment</th></tr>"), first, td(blank, blank),
                    td(F.concat(F.lit("P"), F.col("c_custkey").cast("string")), blank), F.lit("</table>"))
    pages = table(spark, sf, "customer").select(F.col("c_custkey").alias("page_id"), html.alias("html"))
    b = bind_header(html_rows(pages, "html", ["page_id"]), drop_blank_rows=True)
    return b.select("page_id", F.col("row_index").cast("int").alias("row_index"), b["record"]["Name"].alias("name"), b["record"]["Segment"].alias("segment"))


@query("prepared_frames", f"""
SELECT 'inspection' AS mode, 0 AS place, 'water_systems' AS data_type, 6 AS n_fields, CAST(count(*) AS BIGINT) AS n FROM ({WS_DEDUP_SQL}) a
UNION ALL SELECT 'inspection', 1, 'legal_entities', 6, CAST(count(*) AS BIGINT) FROM ({LE_SQL}) b
UNION ALL SELECT 'general', 0, 'sample_schedules', 2, CAST(count(*) AS BIGINT) FROM orders
UNION ALL SELECT 'general', 1, 'water_systems', 8, CAST(count(*) AS BIGINT) FROM ({WS_DEDUP_SQL}) c""")
def q_prepared_frames(spark, sf):
    """PIP-5 with PRJ-7..10: which datasets, in what order, with how many fields."""
    frames = {"sample_schedules": table(spark, sf, "orders").selectExpr("o_orderkey as `Schedule ID`", "o_custkey as `PWS ID`"),
              "legal_entities": legal_entities(spark, sf), "water_systems": ws_dedup(spark, sf)}
    out = []
    for mode, name, chosen in (("inspection", "inspection_report", None), ("general", "general_export", ["sample_schedules", "absent", "water_systems"])):
        got = ex.prepare_export(frames, load_schema(spark, name), mode, chosen)
        out += [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), F.lit(i).alias("place"), F.lit(t).alias("data_type"),
                                                            F.lit(len(df.columns)).alias("n_fields"), "n")
                for i, (t, df) in enumerate(got.items())]
    return dedup.union_by_name(out)


@query("custom_transform", "SELECT right(c_name, 4) AS last4, lower(c_mktsegment) AS segment FROM customer")
def q_custom_transform(spark, sf):
    """UDF-1: a transform registered by the caller, named in a field rule."""
    register_transform("last4", lambda c: F.right(c, F.lit(4)))
    c = table(spark, sf, "customer")
    fields = [FieldRule("c_name", "last4", transform="last4"), FieldRule("c_mktsegment", "segment", transform="lower")]
    return c.select(*[project.rule_column(c, f) for f in fields])


@query("output_fanout", f"""
SELECT 'water_systems' AS data_type, 'export_water_systems_<stamp>.csv' AS file, CAST(count(*) AS BIGINT) AS n FROM ({WS_DEDUP_SQL}) a
UNION ALL SELECT 'legal_entities', 'export_legal_entities_<stamp>.csv', CAST(count(*) AS BIGINT) FROM ({LE_DEDUP_SQL}) b
UNION ALL SELECT 'deficiency_types', 'export_deficiency_types_<stamp>.csv', CAST(count(*) AS BIGINT) FROM ({DEF_SQL}) c
UNION ALL SELECT 'failed runs', 'runs', 1""")
def q_output_fanout(spark, sf):
    """SNK-15 and SNK-13: one file set per dataset under its own name, read
    back; the failed dataset is a row of the run log and has no file."""
    run = scratch_path(spark, f"fanout-{uuid.uuid4().hex}")
    landings = {"water_systems": standins.water_system_grid(spark, sf), "legal_entities": standins.legal_entity_grid(spark, sf),
                "deficiency_types": standins.deficiency_rows(spark, sf), "sample_schedules": spark.range(1)}
    res = ex.export(spark, ex.ExportConfiguration(tuple(landings), "general", "csv", output_path=run + "/export.csv"), landings)
    append_runs(res["runs"], run + "/runs")
    ok = [r["data_type"] for r in spark.read.parquet(run + "/runs").filter("success").orderBy("seq").collect()]  # one row per dataset
    out = [read_csv(spark, res["paths"][t]).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(t).alias("data_type"), F.regexp_replace(F.lit(res["paths"][t].rsplit("/", 1)[1]), r"\d{8}_\d{6}", "<stamp>").alias("file"), "n") for t in ok]
    failed = spark.read.parquet(run + "/runs").filter("not success and size(errors) = 1").agg(F.count(F.lit(1)).alias("n"))
    return dedup.union_by_name([*out, failed.select(F.lit("failed runs").alias("data_type"), F.lit("runs").alias("file"), "n")])


@query("fallback_extract", """
WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS kind, p_brand, p_type, p_name FROM part)
SELECT k AS page_no, 1 AS row_index, p_brand AS code, p_type AS severity, 'main' AS source FROM p WHERE kind = 0
UNION ALL SELECT k, 2, p_name, p_type, 'wide' FROM p WHERE kind = 1
UNION ALL SELECT k, 1, p_type, p_type, 'wide' FROM p WHERE kind = 1
UNION ALL SELECT k, 1, p_brand, p_type, 'table' FROM p WHERE kind = 2
UNION ALL SELECT k, 2, p_name, '', 'table' FROM p WHERE kind = 2""")
def q_fallback_extract(spark, sf):
    """SRC-4 inside an extraction: array, largest other array or table of the
    page, whose columns stand in another order."""
    q = lambda *c: F.to_json(F.array(*c))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 4).alias("kind"), "p_brand", "p_type", "p_name")
    row = lambda code, source: q(code, F.col("p_type"), F.lit("c"), F.lit(source))
    arrays = (F.when(F.col("kind") == 0, F.concat(F.lit('"main": ['), row(F.col("p_brand"), "main"), F.lit('], "wide": [[1], [2]]')))
              .when(F.col("kind") == 1, F.concat(F.lit('"main": [], "thin": [["t"]], "wide": ['), row(F.col("p_type"), "wide"), F.lit(","),
                                                 row(F.col("p_name"), "wide"), F.lit("]"))).otherwise(F.lit('"main": []')))
    html = F.concat(F.lit("<table><tr><th>Description</th><th>Default Severity Code</th><th>Type Code</th></tr><tr><td>table</td><td>"), "p_type",
                    F.lit("</td><td>"), "p_brand", F.lit("</td></tr><tr><td>table</td><td></td><td>"), "p_name", F.lit("</td></tr></table>"))
    pages = p.select(F.when(F.col("kind") == 2, html).alias("html"),
                     F.parse_json(F.concat(F.lit('{"page_no": '), "k", F.lit(', "capture_id": "c0", '), arrays, F.lit("}"))).alias("page"))
    landing = ex.landing_with_fallback(pages, "deficiency_types", ["main", "thin", "wide"])
    e = ex.extract(spark, ex.ExtractionQuery("deficiency_types"), landing)
    return e.records.select("page_no", F.col("row_index").cast("int").alias("row_index"), F.col("`Type Code`").alias("code"),
                            F.col("`Default Severity Code`").alias("severity"), F.col("Description").alias("source"))


@query("schedule_fallback", """
SELECT o_orderkey AS page_no, 'S' || o_orderkey AS schedule, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'F' || o_custkey END AS facility FROM orders""")
def q_schedule_fallback(spark, sf):
    """SRC-3 inside an extraction: the array of a page, else its schedules table."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("S"), "o_orderkey").alias("s"), F.concat(F.lit("F"), "o_custkey").alias("f"))
    in_table = F.col("o_orderkey") % 3 == 0
    main = F.when(in_table, F.lit("[]")).otherwise(F.concat(F.lit('[["x", '), F.to_json(F.array(F.col("s"), F.lit("P1"), F.col("f"))), F.lit("]]")))
    html = F.concat(F.lit('<table class="DFGUILBX"><tr><th>PWS ID</th><th>Schedule ID</th></tr><tr><td>P1</td><td>'), "s", F.lit("</td></tr></table>"))
    pages = o.select(F.when(in_table, html).alias("html"), F.parse_json(F.concat(
        F.lit('{"page_no": '), "o_orderkey", F.lit(', "capture_id": "c0", "main": '), main, F.lit("}"))).alias("page"))
    e = ex.extract(spark, ex.ExtractionQuery("sample_schedules"), ex.landing_with_fallback(pages, "sample_schedules", ["main"]))
    return e.records.select("page_no", F.col("`Schedule ID`").alias("schedule"), F.col("`Facility ID`").alias("facility"))


@query("large_numbers", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '9' || lpad(CAST(o_orderkey AS VARCHAR), 20, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS txt FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS digits, txt AS exact,
       CASE WHEN o_orderkey % 3 = 0 THEN 'NUMBER_TOO_LARGE' END AS code, CASE WHEN o_orderkey % 3 = 0 THEN 'CA' || txt END AS reported FROM t""")
def q_large_numbers(spark, sf):
    """FN-6, FN-14: numbers past BIGINT are kept as DECIMAL and reported with their text."""
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("9"), F.lpad(k.cast("string"), 20, "0"))).otherwise(k.cast("string"))
    t = table(spark, sf, "orders").select("o_orderkey", text.alias("txt"), F.concat(F.lit("CA"), text).alias("fid"))
    issues = rules.validate(t, [rules.fits_bigint("fid", r"^[A-Z]{2}([0-9]+)")], ["o_orderkey"])
    return t.join(issues.select("o_orderkey", "code", F.col("value").alias("reported")), "o_orderkey", "left").select(
        "o_orderkey", digits_or_null("txt").alias("digits"), exact_integer("txt").cast("string").alias("exact"), "code", "reported")
