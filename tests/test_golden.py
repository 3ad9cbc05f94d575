"""Golden cases recovered from the source's own tests (FIXTURES.md §4)."""

from pyspark.sql import functions as F

from gridwright.operators import bind, project
from gridwright.sources.grid import LANDING_KEYS

# Fixed values: (entity_info, field_2, field_3, field_9) → expected record.
LEGAL_CASES = [
    ("SMITH, JOHN", "&nbsp", "&nbsp", "MS19350", ("SMITH, JOHN", "", "", "MS", 19350)),
    ("DOE, JANE", "Smith&nbspCorporation", "123&nbspMain&nbspSt", "MS12345",
     ("DOE, JANE", "Smith Corporation", "123 Main St", "MS", 12345)),
    ("BROWN, BOB", "", "", "MS67890", ("BROWN, BOB", "", "", "MS", 67890)),
    ("JONES, MARY", "ACME Corp", "Suite 200", "MS11111", ("JONES, MARY", "ACME Corp", "Suite 200", "MS", 11111)),
    ("JONES, BILL", "&nbsp;", "&nbsp;", "MS55555", ("JONES, BILL", "", "", "MS", 55555)),
]


def _landing(spark, rows):
    data = [("legal_entities", "c0", 0, i, cells) for i, cells in enumerate(rows)]
    return spark.createDataFrame(data, "dataset string, capture_id string, page_no bigint, row_no bigint, "
                                       "cells array<array<string>>")


def test_legal_entity_golden(spark):
    rows = [[[a], ["IN"], [b], [c], ["x"], ["x"], ["x"], ["x"], ["x"], [d]] for a, b, c, d, _ in LEGAL_CASES]
    out = bind.bind_legal_entities(_landing(spark, rows)).orderBy("row_no").collect()
    got = [(r["Individual Name"], r["Organization"], r["Mail Stop"], r["State Code"], r["ID Number"]) for r in out]
    assert got == [c[-1] for c in LEGAL_CASES]


def test_legal_entity_filters(spark):
    rows = [[["ABC"], ["IN"]],             # name too short (FLT-3)
            [["LONGER NAME"]],             # one cell (FLT-1)
            [["SOLO NAME&nbsp;"], ["IN"]],  # no comma: last name only
            [["SMITH,"], ["IN"]]]          # empty first name
    out = bind.bind_legal_entities(_landing(spark, rows)).orderBy("row_no").collect()
    assert [r["Individual Name"] for r in out] == ["SOLO NAME", "SMITH"]
    assert [r["ID Number"] for r in out] == [0, 0]


def test_deficiency_mapping_golden(spark):
    df = spark.createDataFrame([("CG000", "SIG", "", "SIGNIFICANT DEFICIENCY TEST", 1)],
                               "`Type Code` string, `Default Severity Code` string, "
                               "`Default Category Code` string, Description string, row_index int")
    r = project.snake_rename(df, project.DEFICIENCY_RENAMES).first().asDict()
    assert r == {"code": "CG000", "typical_severity": "SIG", "typical_category": "",
                 "description": "significant deficiency test", "row_index": 1}


def test_water_system_binding(spark):
    rows = [
        [["A"], ["&nbsp;0100001&nbsp"], ["Town&nbsp;Water"], ["GW"], ["C"], ["C"], [" 1500 "], ["HINDS"]],
        [["A"], ["&nbsp;"], ["No key"], ["GW"], ["C"], ["C"], ["1"], ["X"]],         # empty key: dropped
        [["A"], ["0100002"], ["Short"]],                                               # < 8 cells: dropped
        [["I"], ["0100003"], [], None, ["C"], ["C"], ["7"], ["Y"]],                    # empty / missing cells → ''
    ]
    data = [("water_systems", "c0", 0, i, cells) for i, cells in enumerate(rows)]
    df = spark.createDataFrame(data, "dataset string, capture_id string, page_no bigint, row_no bigint, "
                                     "cells array<array<string>>")
    out = bind.bind_water_systems(df).orderBy("row_no").collect()
    assert [r["Water System No."] for r in out] == ["0100001", "0100003"]
    assert out[0]["Name"] == "Town Water" and out[0]["Population"] == "1500"
    assert out[1]["Name"] == "" and out[1]["Federal Primary Source"] == ""


def test_deficiency_variant_binding(spark):
    texts = ['[["CG000"], "SIG", [""], ["A&nbsp;desc"]]', '["X1", "S", "C", "plain"]', '[["", 1], "S", "C", "d"]',
             '["only", "three", "cells"]', '{"Type Code": "obj"}', '[["T9"], true, [], [15000]]']
    df = spark.createDataFrame([("deficiency_types", "c0", 0, i, t) for i, t in enumerate(texts)],
                               "dataset string, capture_id string, page_no bigint, row_no bigint, t string")
    df = df.select(*LANDING_KEYS, F.parse_json("t").alias("row"))
    out = bind.bind_deficiency_types(df).orderBy("row_no").collect()
    assert [(r["Type Code"], r["Default Severity Code"], r["Description"], r["row_index"]) for r in out] == [
        ("CG000", "SIG", "A desc", 1), ("X1", "S", "plain", 2), ("T9", "True", "15000", 6)]
    assert out[-1]["Default Category Code"] == "[]"  # str([]) of an empty array cell
    gen = bind.bind_generic(df).orderBy("row_index").collect()
    assert gen[4]["record"] == {"Type Code": "obj"}
    assert gen[5]["record"]["Default Severity Code"] == "True"
    assert len(gen) == 6
