"""Sources and sinks: landed captures, HTML tables, schema files, CSV/TSV,
JSON documents, run log, output paths, streaming ingest."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gridwright import sinks, streaming
from gridwright.operators import bind, project
from gridwright.sinks import ordered
from gridwright.sources import grid, html, schema_files


def test_captures_roundtrip(spark, tmp_path):
    pages = [
        {"dataset": "water_systems", "capture_id": "c1", "page_no": 0, "total": " 3 ",
         "values": [[["A"], ["0100001"], ["N1"], ["GW"], ["C"], ["C"], ["10"], ["X"]],
                    [["A"], ["0100002"], ["N2"], "scalar", ["C"], ["C"], [15000], ["X"]]]},
        {"dataset": "water_systems", "capture_id": "c1", "page_no": 1, "values": None},
        {"dataset": "water_systems", "capture_id": "c1", "page_no": 2, "values": [[["A"], ["0100001"], ["dup"],
                                                                                   ["GW"], ["C"], ["C"], ["1"], ["X"]]]},
    ]
    p = tmp_path / "caps"
    p.mkdir()
    (p / "part-0.json").write_text("\n".join(json.dumps(x) for x in pages))
    raw = grid.read_captures(spark, str(p))
    landing = grid.to_strict(grid.explode_rows(raw))
    ws = bind.bind_water_systems(landing).orderBy("page_no", "row_no").collect()
    assert [r["Water System No."] for r in ws] == ["0100001", "0100002", "0100001"]
    assert ws[1]["Federal Primary Source"] == "" and ws[1]["Population"] == "15000"
    totals = grid.reported_totals(raw).collect()
    assert [(r["capture_id"], r["total_available"]) for r in totals] == [("c1", 3)]


def test_choose_and_largest_source(spark):
    cand = spark.createDataFrame([("c1", "main", 0, 0), ("c1", "other", 1, 5), ("c1", "table", 2, 9),
                                  ("c2", "main", 0, 3)], "capture_id string, source string, priority int, n_rows int")
    assert dict(grid.choose_source(cand).select("capture_id", "source").collect()) == {"c1": "other", "c2": "main"}
    arrs = spark.createDataFrame([("c1", "a", 0, 3), ("c1", "b", 1, 3), ("c1", "c", 2, 0)],
                                 "capture_id string, name string, ord int, size int")
    assert grid.largest_array(arrs).first()["name"] == "a"  # first found wins ties


HTML = """<html><body><table><tr><td>only</td></tr></table>
<table class="DFGUILBX"><tr><th>Code</th><th></th><th>Code</th></tr>
<tr><td> A1 </td><td>x<b>y</b></td><td>dup</td>
<tr><td>&amp;B2</td><td>z</td></tr><tr></tr><tr><td></td><td></td></tr></table></body></html>"""


def test_html_tables(spark):
    t = html.parse_tables(HTML)
    assert t == [[["Code", "", "Code"], ["A1", "xy", "dup"], ["&B2", "z"], ["", ""]]]
    df = spark.createDataFrame([(1, HTML), (2, None)], "page_id long, html string")
    rows = html.html_rows(df, css_class="DFGUILBX")
    bound = html.bind_header(rows).orderBy("row_index").collect()
    assert bound[0]["record"] == {"Code": "dup", "column_1": "xy"} and bound[0]["row_index"] == 1
    assert bound[1]["record"] == {"Code": "&B2", "column_1": "z"}
    assert len(bound) == 3
    assert html.bind_header(rows, drop_blank_rows=True).count() == 2
    lists = html.html_rows(spark.createDataFrame([(1, "<ul><li>a<li>b</ul>")], "page_id long, html string"),
                           container="ul", row="li", cells=())
    assert [r["cells"] for r in lists.orderBy("row_no").collect()] == [["a"], ["b"]]


def test_schedule_table(spark):
    page = ('<table class="other"><tr><td>x</td></tr><tr><td>y</td></tr></table>'
            '<table class="DFGUILBX grid"><tr><th>PWS ID</th><th>Status</th></tr>'
            '<tr><td>0100001</td><td>A</td><td>extra</td></tr><tr><td>short</td></tr>'
            '<tr><td>0100002</td><td>I</td></tr></table>')
    df = spark.createDataFrame([(7, page)], "page_id long, html string")
    got = [r["record"] for r in html.schedule_tables(df).orderBy("row_index").collect()]
    assert got == [{"PWS ID": "0100001", "Status": "A"}, {"PWS ID": "0100002", "Status": "I"}]


def test_schema_files(spark, tmp_path):
    s = schema_files.load_schema(spark, "inspection_report")
    ws = s.rules("water_systems")
    assert [f.output_field for f in ws.fields][:2] == ["system_number", "system_name"]
    assert "sample_schedules" not in s.datasets
    req = {f.output_field: f.required for d in s.datasets.values() for f in d.fields}
    assert req["system_number"] and req["system_name"] and req["entity_name"] and req["code"]
    assert not req["population"] and not req["status"] and not req["organization"] and not req["description"]
    assert all(f.description for d in s.datasets.values() for f in d.fields)
    g = schema_files.load_schema(spark, "general_export")
    assert g.rules("water_systems").include_all_fields
    with pytest.raises(schema_files.SchemaFileError):
        schema_files.load_schema(spark, "missing_schema")
    bad = tmp_path / "bad.json"
    bad.write_text("{not json")
    with pytest.raises(schema_files.SchemaFileError):
        schema_files.load_schema(spark, str(bad))
    with pytest.raises(schema_files.SchemaFileError):
        schema_files.parse_schema({"schema_info": {"name": "x", "description": "d"}})
    with pytest.raises(schema_files.SchemaFileError):
        schema_files.parse_schema({"schema_info": {"name": "x", "description": "d"},
                                   "data_types": {"water_systems": {"fields": {"a": {"source_field": "A"}}}}})
    odd = schema_files.parse_schema({"schema_info": {"name": "x", "description": "d"}, "data_types": {
        "future_type": {}, "legal_entities": {"fields": {"a": {"source_field": "A", "output_field": "a",
                                                               "field_type": "weird"}}}}})
    assert list(odd.datasets) == ["legal_entities"] and odd.rules("legal_entities").fields[0].field_type == "string"
    assert schema_files.rules_frame(spark, s).count() == 16


def test_projection_modes(spark):
    s = schema_files.load_schema(spark, "inspection_report")
    ws = spark.createDataFrame([("0100001", "N", "10", "X", "A", "C", "extra")],
                               "`Water System No.` string, Name string, Population string, "
                               "`Principal County Served` string, `Activity Status` string, `State Type` string, "
                               "other string")
    sched = spark.createDataFrame([("S1",)], "`Schedule ID` string")
    frames = {"sample_schedules": sched, "water_systems": ws}
    insp = project.transform_datasets(frames, s, "inspection")
    assert list(insp) == ["water_systems"]
    assert insp["water_systems"].columns == ["system_number", "system_name", "population", "county",
                                             "activity_status", "system_type"]
    gen = project.transform_datasets(frames, schema_files.load_schema(spark, "general_export"), "general",
                                     ["water_systems", "nope", "sample_schedules"])
    assert list(gen) == ["water_systems", "sample_schedules"] and gen["water_systems"].columns == ws.columns
    le = spark.createDataFrame([("SMITH, JOHN",)], "`Individual Name` string")
    out = project.project(le, s.rules("legal_entities")).first().asDict()
    assert out["entity_name"] == "SMITH, JOHN" and out["id_number"] is None
    assert project.rename_for_mode(ws, "water_systems", "inspection").columns[:2] == ["system_number", "name"]
    keys = spark.createDataFrame([("water_systems",), ("deficiency_types",), ("x",)], "t string")
    assert [r[0] for r in keys.select(project.output_key("t")).collect()] == ["all_water_systems", "deficiency_types",
                                                                             "all_x"]
    assert [r[0] for r in keys.select(project.output_key("t", legacy=True)).collect()][1] == "all_deficiency_types"


def test_csv_tsv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok', None, "  padded  "), (2, "line1\nline2", "", "x")],
                               "id long, a string, b string, c string")
    for sep in [",", "\t"]:
        path = str(tmp_path / f"out{ord(sep)}")
        sinks.write_csv(df, path, sep=sep)
        back = sinks.read_csv(spark, path, df.schema, sep=sep).orderBy("id").collect()
        assert back[0]["a"] == 'say "hi", ok' and back[0]["c"] == "  padded  "
        assert back[1]["a"] == "line1\nline2"
        assert back[0]["b"] in (None, "") and back[1]["b"] in (None, "")
    nested = spark.sql("select 1 id, named_struct('x', 1, 'y', named_struct('z', 'q')) s, array(1, 2) l")
    assert project.flatten(nested).columns == ["id", "s_x", "s_y_z", "l"]
    assert project.flatten(nested).first()["l"] == "1, 2"


def joined(doc):
    """The document, from its table of lines."""
    return json.loads("\n".join(r["line"] for r in doc.lines().orderBy("part", "idx").collect()))


def test_json_documents(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 'x"\n')], "k int, v string, n string")
    d = joined(sinks.json_document(df, "all_water_systems", {"total_records": 2}, order=["k"]))
    assert d == {"all_water_systems": [{"v": "a", "n": 'x"\n'}, {"v": "b", "n": None}], "extraction_summary": {"total_records": 2}}
    insp = joined(sinks.inspection_document({"legal_entities": df, "water_systems": df.limit(0)}))
    assert list(insp) == ["water_systems", "legal_entities"] and insp["water_systems"] == []
    with pytest.raises(ValueError):
        sinks.inspection_document({})


def test_document_files_in_name_order(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v")).repartition(7)
    path = str(tmp_path / "doc")
    sinks.write_document(sinks.json_document(df, "rows", {"n": 5000}, order=["k"]), path)
    d = json.loads(text_of(spark, path))
    assert [r["v"] for r in d["rows"]] == [f"v{k}" for k in range(5000)] and d["extraction_summary"] == {"n": 5000}
    back = sinks.read_ordered(spark, path).orderBy("section", "piece", "block", "at").collect()
    assert json.loads("\n".join(r["line"] for r in back)) == d
    sinks.write_document(sinks.json_document(df.limit(0), "rows"), path)  # an earlier text is replaced
    assert json.loads(text_of(spark, path)) == {"rows": []}


def text_of(spark, path):
    return "".join(open(os.path.join(path, f)).read() for f, _ in ordered.manifest(spark, path))


def test_manifest_guards_the_text(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_ordered(spark, [["a", "b"], spark.range(3).select(F.col("id").cast("string").alias("line"))], path)
    assert text_of(spark, path) == "a\nb\n0\n1\n2\n"
    first = os.path.join(path, ordered.manifest(spark, path)[0][0])
    with open(first, "a") as f:
        f.write("more\n")
    crc = os.path.join(os.path.dirname(first), "." + os.path.basename(first) + ".crc")
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(sinks.ManifestError):
        sinks.read_ordered(spark, path)
    os.remove(os.path.join(path, ordered.MANIFEST))
    with pytest.raises(sinks.ManifestError):
        sinks.read_ordered(spark, path)


def test_names_stay_in_order_past_99999_parts(spark):
    parts = spark.range(0, 100_003, 50_001).select(F.lpad(F.col("id").cast("string"), ordered.PIECE_DIGITS, "0").alias("p"))
    names = [f"{k:0{ordered.PIECE_DIGITS}d}" for k in range(100_003)]
    assert names == sorted(names) and {r["p"] for r in parts.collect()} == {names[0], names[50_001], names[100_002]}
    files = [(f"{ordered.section_name(2)}/piece={n}/part-{k:05d}-x.txt", 1) for k, n in enumerate(names)]
    files += [(f"{ordered.section_name(3)}/piece={names[0]}/part-00000-x.txt", 1)]
    ordered.check_manifest(files, files)  # name order is number order
    assert sorted(files) == files
    with pytest.raises(sinks.ManifestError):
        ordered.check_manifest(files, files[:-1])


def test_writing_a_ranged_table_sorts_once(spark):
    d = spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("line"))
    plan = ordered.ranged(d, [F.col("k")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange rangepartitioning") == 1


def test_schema_faults_are_reported_together():
    with pytest.raises(schema_files.SchemaFileError) as e:
        schema_files.parse_schema({"schema_info": {"name": "x"}, "data_types": {"water_systems": {"fields": {"a": {}, "b": 3}}}})
    assert len(e.value.faults) == 6


def test_schema_by_uri_and_directory(spark, tmp_path):
    doc = {"schema_info": {"name": "n", "description": "d"}, "data_types": {"legal_entities": {"include_all_fields": True}}}
    (tmp_path / "own.json").write_text(json.dumps(doc, indent=1))
    for place, where in ((str(tmp_path / "own.json"), None), ("own", str(tmp_path)), ((tmp_path / "own.json").as_uri(), None)):
        s = schema_files.load_schema(spark, place.replace("file:///", "file:///"), where)
        assert s.name == "own" and s.rules("legal_entities").include_all_fields


def test_runs_metadata_and_paths(spark, tmp_path):
    runs = spark.createDataFrame([("r1", 0, "water_systems", True, 10, 1.5, None)],
                                 "run_id string, seq long, data_type string, success boolean, extracted_count long, "
                                 "extraction_time double, total_available long") \
        .withColumn("extraction_timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    meta = sinks.metadata_rows(spark, runs, "general").orderBy("seq").collect()
    assert [r["key"] for r in meta] == ["Data Type", "Extracted Count", "Extraction Time", "Timestamp", "Export Mode"]
    assert meta[2]["value"] == "1.50 seconds"
    path = str(tmp_path / "runs")
    full = runs
    for f in sinks.RUNS_SCHEMA.fields:
        if f.name not in full.columns:
            full = full.withColumn(f.name, F.lit(None).cast(f.dataType))
    sinks.append_runs(full, path)
    sinks.append_runs(full.withColumn("success", F.lit(False)), path)
    assert spark.read.parquet(path).count() == 2
    pre = str(tmp_path / "pre")
    sinks.write_csv_with_preamble(spark.createDataFrame([(1, "a"), (2, " b,")], "k int, `v, w` string").coalesce(1), runs, pre, "general")
    text = text_of(spark, pre)
    assert text.startswith("Data Type,water_systems\n") and text.endswith('\n\nk,"v, w"\n1,a\n2," b,"\n')
    assert sinks.output_paths(["water_systems"], "out.csv", "T", ".csv") == {"water_systems": "out.csv"}
    assert sinks.output_paths(["a", "b"], "out.csv", "T", ".csv") == {"a": "out_a_T.csv", "b": "out_b_T.csv"}
    assert list(sinks.output_paths(["a", "b"], None, "T", ".json", mode="inspection")) == ["inspection"]


def test_stream_dedup(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    import time
    t0 = time.time() - 100
    for i, names in enumerate([["a", "b"], ["b", "c"], ["a", "d"]]):
        f = land / f"p{i}.json"
        f.write_text("\n".join(json.dumps({"page_no": i, "name": n}) for n in names))
        os.utime(f, (t0 + 10 * i, t0 + 10 * i))  # arrival order = file age
    out = streaming.ingest_pages(spark, str(land), "page_no long, name string", ["name"], str(tmp_path / "sink"),
                                 str(tmp_path / "ckpt"), max_files_per_trigger=1)
    rows = {r["name"]: r["page_no"] for r in out.collect()}
    assert rows == {"a": 0, "b": 0, "c": 1, "d": 2}  # first to arrive wins across micro-batches


def test_run_document_styles(spark):
    from datetime import datetime
    recs = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    run = spark.createDataFrame([("r", 0, "deficiency_types", True, 2, 1.005, None, datetime(2024, 1, 2, 3, 4, 5),
                                  {"extractor": "x"}, {}, [], ["w1"])], sinks.RUNS_SCHEMA)
    std = joined(sinks.run_document(recs, run, "standard", order=["k"]))
    assert list(std) == ["all_deficiency_types", "extraction_summary"]
    gen_one = joined(sinks.run_document(recs, run, "general"))
    assert list(gen_one) == ["deficiency_types", "extraction_summary"]
    assert gen_one["extraction_summary"]["export_mode"] == "general"
    assert [r["v"] for r in std["all_deficiency_types"]] == ["a", "b"]
    es = std["extraction_summary"]
    assert es["expected_total"] is None and es["timestamp"] == "2024-01-02T03:04:05"
    assert es["source_info"] == {"extractor": "x"} and es["warnings"] == ["w1"] and "errors" not in es
    assert "pagination_info" not in es
    det = joined(sinks.run_document(recs, run, "detailed"))
    assert det["metadata"]["result_metadata"]["has_warnings"] is True
    assert det["metadata"]["extraction_metadata"]["source_info"] == {"extractor": "x"}
    cmp_ = joined(sinks.run_document(recs, run, "compact"))
    assert set(cmp_) == {"all_deficiency_types", "count", "timestamp"} and cmp_["count"] == 2
    gen = joined(sinks.general_document({"deficiency_types": recs}, run))
    assert gen["extraction_summary"]["total_available"] is None
    assert gen["data_type_summaries"]["deficiency_types"]["success"] is True


def test_plain_markup_gives_the_parser_s_tree():
    import random
    rng = random.Random(4)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "<td class='a b'>", "<TH Class=x>", "</td>", "</th>", "<br>", "<br/>", "<img src=\"a\"/>",
            "<ul>", "<li>", "</ul>", "<b>", "</b>", "a &amp; b", " x ", "&lt;", "&nbsp", "é ", "text", "<p >", "</p >", "<td/>", "<select><option>"]
    odd = ["<!-- c -->", "<script>a<b</script>", "a < b", "<td a==b>", "</td x>", "<?php ?>", "<![CDATA[x]]>", "<title>t</title>", "<"]

    def shape(n):
        return n if isinstance(n, str) else (n.tag, n.attrs, [shape(c) for c in merged(n.children)])

    def merged(children):
        out = []
        for c in children:
            if isinstance(c, str) and out and isinstance(out[-1], str):
                out[-1] += c
            else:
                out.append(c)
        return out

    plain = 0
    for _ in range(1500):
        page = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        tree = html.plain_tree(page)
        plain += tree is not None
        assert tree is None or shape(tree) == shape(html.full_tree(page)), page
    assert plain > 1400
    for o in odd:
        assert html.plain_tree(f"<table><tr><td>{o}</td></tr></table>") is None, o


def test_one_pass_scan_reads_what_the_tree_has():
    import random
    rng = random.Random(5)
    bits = ["<table>", "<table class='g x'>", "</table>", "<tr>", "<tr/>", "</tr>", "<td>", "<td class='a b'>", "<TH Class=x>", "</td>", "</th>", "<br>",
            "<ul class=g>", "<li>", "</ul>", "<div class=g>", "</div>", "<b>", "</b>", "a &amp; b", " x ", "&lt;", "&nbsp", "é", "a > b", "　z﻿",
            "<p >", "<td/>", "<!-- c -->", "x>b<", "<td a='>'>"]
    shapes = [("table", "tr", ("td", "th"), None), ("table", "tr", ("td", "th"), "g"), ("ul", "li", (), None), ("div", "div", ("div",), "g"), ("tr", "td", ("b", "td"), None)]
    scans, plain, found = [html.PlainScan(*s) for s in shapes], 0, 0
    for k in range(3000):
        page = "".join(rng.choices(bits[:-3] if k % 3 else bits, k=rng.randint(0, 30)))
        shape, scan = shapes[k % 5], scans[k % 5]
        assert (scan.tables(page) is None) == (html.plain_tree(page) is None), page
        plain += scan.tables(page) is not None
        want = [[["".join(c) for c in r] for r in t] for t in html._tree_tables(page, *shape)]
        got = [[[html.js_trim("".join(c)) for c in r] for r in t] for t in scan.tables(page) or []]
        if scan.tables(page) is not None:
            found += bool(want)
            assert got == [[[html.js_trim(c) for c in r] for r in t] for t in want], (page, shape)
    assert plain > 2000 and found > 300


def test_pages_are_not_merged_by_their_bytes(spark, sf_small):
    from gridwright.plans.catalog import _order_pages
    pages = _order_pages(spark, sf_small, "grid")
    assert html.html_rows(pages).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parsed_rows_are_worked_out_once(spark):
    from gridwright.functions._util import once
    from gridwright.operators import bind
    from gridwright.plans.export import landing_with_fallback
    parsed = lambda c: F.parse_json(F.col(c))
    texts = spark.createDataFrame([("c0", 0, 0, '[["a&nbsp;"],"b",["c"],true]'), ("c0", 0, 1, "[1]"), ("c0", 0, 2, None)],
                                  "capture_id string, page_no bigint, row_no bigint, t string")
    rows = texts.select("capture_id", "page_no", "row_no", parsed("t").alias("row"))
    for bound in (bind.bind_deficiency_types(rows), bind.bind_schedules(rows)):
        assert _plan(bound).count("parse_json") + _plan(bound).count("parseJson") == 1, _plan(bound)
    assert [tuple(r) for r in bind.bind_deficiency_types(rows).collect()] == [("c0", 0, 0, "a", "b", "c", "True", 1)]
    pages = spark.createDataFrame([(None, '{"page_no": 1, "capture_id": "c", "main": [["x", ["S1"]]]}'), (None, None),
                                   ('<table class="DFGUILBX"><tr><th>Schedule ID</th></tr><tr><td>S2</td></tr></table>', '{"page_no": 2, "capture_id": "c"}')],
                                  "html string, t string").select("html", parsed("t").alias("page"))
    landing = landing_with_fallback(pages, "sample_schedules", ["main"])
    plan = _plan(landing)
    assert plan.count("parse_json") + plan.count("parseJson") == 3, plan  # a page in each of the two ways, a table's row
    assert sorted(r["Schedule ID"] for r in bind.bind_schedules(landing).collect()) == ["S1", "S2"]
    both = once(pages, "page").select("html", F.col("page").isNull().alias("none"))
    assert [r["none"] for r in both.collect()] == [False, True, False] and once(pages, "page").columns == ["html", "page"]
