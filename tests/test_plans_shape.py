"""Plan shape of every registered query without side effects: no nested-loop
or cartesian joins anywhere, and Python only in the HTML table scans."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from gridwright.plans.catalog import QUERIES

HTML_QUERIES = {"blank_table_rows", "fallback_extract", "schedule_fallback", "fallback_rows", "html_rows", "html_tables", "schedule_tables"}
SIDE_EFFECTS = ("roundtrip", "stream", "export", "report_failure", "capture", "document_files", "preamble", "fanout", "rule_failures", "reported_totals", "json_envelope",
                "inspection_document")
NAMES = sorted(n for n in QUERIES if not any(s in n for s in SIDE_EFFECTS))


@pytest.mark.parametrize("name", NAMES)
def test_plan_shape(spark, sf_small, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()[name](spark, sf_small).explain()
    plan = buf.getvalue()
    assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", plan)
    has_python = bool(re.search(r"MapInPandas|MapInArrow|BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas", plan))
    assert has_python == (name in HTML_QUERIES)
