"""Scalar functions against an independent plain-Python model of the source
semantics, on a grid of awkward values (spaces, NBSP, commas, markup, NULL,
overflow)."""

import re

import pytest
from pyspark.sql import functions as F

from gridwright import functions as G

GRID = ["", " ", "  a  ", "\tTab\t", " nbsp ", " em　", "&nbsp;x&nbsp;", "&nbspy&nbsp",
        "&&nbsp;nbsp;", "a ;b", "x ;;", "A, B", "SMITH,", ",lead", "A, B, C", " MS19350 ", "MS12345abc",
        "ms1", "HQ99999999999999999999", "12", " 12 ", "+7", "-3", "12.5", "1e3", "nan", "inf", "abc",
        "\x1cctl\x1f", "\u0085next\u0085", None]


def py_clean_a(v):
    return v.replace("&nbsp;", " ").replace("&nbsp", " ").strip()


def py_clean_b(v):
    return v.replace("&nbsp;", " ").replace("&nbsp", " ").replace(" ;", " ").strip()


def py_split_join(v):
    if "," in v:
        a, b = v.split(",", 1)
        last, first = a.strip(), b.strip()
    else:
        last, first = v.strip(), ""
    return f"{last}, {first}" if first else last


def py_fid(v):
    m = re.match(r"([A-Z]{2})(\d+)", v)
    if not m:
        return ("", 0)
    n = int(m.group(2))
    return (m.group(1), n if n < 2 ** 63 else 0)


def py_int(v):
    try:
        return int(v) if v else 0
    except (ValueError, TypeError):
        return 0


def py_float(v):
    try:
        return float(v) if v else 0.0
    except (ValueError, TypeError):
        return 0.0


def py_blank(v):
    v = v or ""
    return "" if v.strip() in ("&nbsp;", "&nbsp") or not v.strip() else py_clean_b(v)


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(GRID)], "i int, v string")


def _col(df, expr):
    return {r[0]: r[1] for r in df.select("i", expr.alias("o")).collect()}


def test_strip_matches_python(grid):
    got = _col(grid, G.py_strip("v"))
    for i, v in enumerate(GRID):
        assert got[i] == (None if v is None else v.strip()), repr(v)


def test_clean_variants(grid):
    a, b, c = _col(grid, G.clean_cell("v")), _col(grid, G.clean_cell_semicolon("v")), _col(grid, G.clean_entity_only("v"))
    for i, v in enumerate(GRID):
        if v is None:
            assert a[i] is None and b[i] is None
            continue
        assert a[i] == py_clean_a(v), repr(v)
        assert b[i] == py_clean_b(v), repr(v)
        assert c[i] == v.replace("&nbsp;", " ").strip(), repr(v)


def test_name_split_join(grid):
    s = G.split_name("v")
    got = _col(grid, G.join_name(s["last"], s["first"]))
    for i, v in enumerate(GRID):
        if v is not None:
            assert got[i] == py_split_join(v), repr(v)


def test_federal_id(grid):
    f = G.federal_id(G.clean_cell_semicolon("v"))
    got = {r[0]: (r[1], r[2]) for r in grid.select("i", f["state"], f["number"]).collect()}
    for i, v in enumerate(GRID):
        if v is not None:
            assert got[i] == py_fid(py_clean_b(v)), repr(v)


def test_blank_if_markup(grid):
    got = _col(grid, G.blank_if_markup("v"))
    for i, v in enumerate(GRID):
        assert got[i] == py_blank(v), repr(v)


def test_int_and_float_transforms(grid):
    gi = _col(grid, G.apply_transform(F.col("v"), "int", "string"))
    gf = _col(grid, G.apply_transform(F.col("v"), "float", "string"))
    for i, v in enumerate(GRID):
        if v is None:
            assert gi[i] is None and gf[i] is None  # NULL skips the transform
            continue
        if "\x1c" in v or "\u0085" in v:
            continue
        assert gi[i] == py_int(v), repr(v)
        want = py_float(v)
        assert (gf[i] != gf[i] and want != want) or gf[i] == want, repr(v)


def test_unknown_transform_is_identity(grid):
    got = _col(grid, G.apply_transform(F.col("v"), "no_such", "string"))
    assert [got[i] for i in range(len(GRID))] == GRID


def test_digits_or_null(grid):
    got = _col(grid, G.digits_or_null("v"))
    for i, v in enumerate(GRID):
        if v is None:
            continue
        s = v.strip()
        want = int(s) if s and re.fullmatch(r"[0-9]+", s) else None
        assert got[i] == want, repr(v)


def test_title_label_and_snake(spark):
    vals = ["water_systems", "abc2def", "x", "", "legal_entities_v2b"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(G.title_label("v")).collect()]
    assert got == [v.replace("_", " ").title() for v in vals]
    got = [r[0] for r in df.select(G.snake_case(F.lit("Type Code"))).collect()]
    assert got[0] == "type_code"


def test_iso_timestamp_and_duration(spark):
    df = spark.sql("select timestamp_ntz'2024-01-02 03:04:05' a, timestamp_ntz'2024-01-02 03:04:05.120000' b")
    r = df.select(G.iso_timestamp("a"), G.iso_timestamp("b"), G.duration_text(F.lit(2.5)),
                  G.duration_text(F.lit(2.5), "long")).first()
    assert r[0] == "2024-01-02T03:04:05"
    assert r[1] == "2024-01-02T03:04:05.120000"
    assert r[2] == "2.50s" and r[3] == "2.50 seconds"


def test_error_classification(spark):
    msgs = ["Authentication failed; session gone", "SESSION expired", "pagination stuck", "boom", None]
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    got = [r[0] for r in df.select(G.classify_extraction_error("m")).collect()]
    assert got == ["authentication_error", "session_error", "pagination_error", "extraction_error",
                   "extraction_error"]
    df2 = spark.createDataFrame([("ValueError", "bad format x"), ("PermissionError", "no"), ("KeyError", "format")],
                                "t string, m string")
    got = [r[0] for r in df2.select(G.classify_output_error("t", "m")).collect()]
    assert got == ["invalid_format", "write_failure", "export_failure"]


def test_version_compat(spark):
    df = spark.createDataFrame([("1.2.0", "1.9.0", True), ("2.0.0", "1.9.0", True), ("2.0.0", "1.9.0", False),
                                ("2", "1.0", True)], "v string, o string, b boolean")
    got = [r[0] for r in df.select(G.version_compatible("v", "o", "b")).collect()]
    assert got == [True, False, True, True]


def test_join_list(spark):
    df = spark.sql("select array(1, null, 3) a")
    assert df.select(G.join_list("a")).first()[0] == "1, None, 3"
