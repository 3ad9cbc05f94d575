"""Positional binding of landed grid rows to named columns, with the row
validity filters of each dataset (PRJ-1..PRJ-5c, FLT-1..FLT-4, FLT-8, WIN-1).

All binders are projections plus filters over the landing table: no shuffle,
no Python. ``LANDING_KEYS`` (dataset, capture_id, page_no, row_no) are carried
through so later steps can order by arrival.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import once
from ..functions.parse import federal_id, join_name, split_name
from ..functions.text import (blank_if_markup, clean_cell, clean_cell_semicolon,
                              clean_entity_only)
from ..sources.grid import LANDING_KEYS

# Column headers of each dataset, in grid position order.
WATER_SYSTEM_HEADERS = ["Activity Status", "Water System No.", "Name", "Federal Primary Source",
                        "Federal Type", "State Type", "Population", "Principal County Served"]
LEGAL_ENTITY_HEADERS = ["Individual Name", "Status", "Organization", "Mail Stop", "State Code",
                        "ID Number"]
DEFICIENCY_TYPE_HEADERS = ["Type Code", "Default Severity Code", "Default Category Code",
                           "Description"]
SAMPLE_SCHEDULE_HEADERS = ["Schedule ID", "PWS ID", "Facility ID", "Schedule Type", "Status",
                           "Sample Count", "Frequency", "Analyte Group"]
# Minimum cells per row (FLT-1) and the required key (FLT-2).
MIN_CELLS = {"water_systems": 8, "legal_entities": 2, "deficiency_types": 4, "sample_schedules": 2}
KEY_COLUMN = {"water_systems": "Water System No.", "legal_entities": "Individual Name",
              "deficiency_types": "Type Code", "sample_schedules": "Schedule ID"}
MIN_NAME_LENGTH = 3  # FLT-3: a name must be longer than this


def _keys(df: DataFrame) -> list[str]:
    return [k for k in [*LANDING_KEYS, "captured_at"] if k in df.columns]


def cell_text(cells: Column, i: int) -> Column:
    """Item 0 of cell ``i``; NULL when the cell is missing, not an array or empty."""
    return F.get(F.get(cells, i), 0)


def min_cells(df: DataFrame, n: int, cells: str = "cells") -> DataFrame:
    """FLT-1: keep rows with at least ``n`` cells."""
    return df.filter(F.size(cells) >= n)


def required_nonempty(df: DataFrame, column: str) -> DataFrame:
    """FLT-2: keep rows whose (cleaned) key is not empty."""
    return df.filter(F.coalesce(F.col(f"`{column}`"), F.lit("")) != "")


def bind_water_systems(landing: DataFrame) -> DataFrame:
    """PRJ-1 + FLT-1 + FLT-2: 8 cleaned text columns; missing cells are ''."""
    rows = min_cells(landing, MIN_CELLS["water_systems"])
    cols = [F.coalesce(clean_cell(cell_text(F.col("cells"), i)), F.lit("")).alias(h)
            for i, h in enumerate(WATER_SYSTEM_HEADERS)]
    return required_nonempty(rows.select(*_keys(landing), *cols), "Water System No.")


def bind_legal_entities(landing: DataFrame) -> DataFrame:
    """PRJ-2 + PRJ-3 + FLT-1 + FLT-3.

    Cell 0 is ``LAST, FIRST``, 1 the status, 2 the organization, 3 the mail
    stop, 9 the federal id. The name and status are cleaned (FN-2) when bound
    and again when parsed, as the source does; organization and mail stop are
    blanked when they hold only markup (FN-5); the federal id splits into state
    code and number (FN-6).
    """
    rows = min_cells(landing, MIN_CELLS["legal_entities"])
    c = F.col("cells")
    info = F.coalesce(clean_cell_semicolon(cell_text(c, 0)), F.lit(""))
    status = F.coalesce(clean_cell_semicolon(cell_text(c, 1)), F.lit(""))
    bound = rows.select(
        *_keys(landing), info.alias("_info"), status.alias("_status"),
        F.coalesce(cell_text(c, 2), F.lit("")).alias("_org"),
        F.coalesce(cell_text(c, 3), F.lit("")).alias("_mail"),
        F.coalesce(cell_text(c, 9), F.lit("")).alias("_fid"),
    ).filter(F.length("_info") > MIN_NAME_LENGTH)
    name = split_name(clean_cell_semicolon(F.col("_info")))
    fid = federal_id(clean_cell_semicolon(F.col("_fid")))
    return bound.select(
        *_keys(landing),
        join_name(name["last"], name["first"]).alias("Individual Name"),
        clean_cell_semicolon(F.col("_status")).alias("Status"),
        blank_if_markup(F.col("_org")).alias("Organization"),
        blank_if_markup(F.col("_mail")).alias("Mail Stop"),
        fid["state"].alias("State Code"),
        fid["number"].alias("ID Number"),
    )


def type_filter(df: DataFrame, column: str = "Status", value: str = "IN") -> DataFrame:
    """FLT-8: the fixed "IN - Individual" type choice."""
    return df.filter(F.col(f"`{column}`") == value)


def py_str(v: Column) -> Column:
    """Python ``str()`` of a VARIANT value as text: strings and numbers as
    they are, booleans ``True`` / ``False``, arrays and objects as JSON text
    (an empty array gives ``[]`` as in Python); JSON null gives NULL (D-1).
    The variant's type is looked up only for the texts ``true``/``false``."""
    s = F.try_variant_get(v, "$", "string")
    is_bool = s.isin("true", "false") & (F.schema_of_variant(v) == "BOOLEAN")
    return F.when(is_bool, F.initcap(s)).otherwise(s)


def _cell_value(r: Column, j: int) -> Column:
    """Cell ``j`` of a ragged row: item 0 of a non-empty array cell, else the
    cell itself, each through Python ``str()`` rules."""
    item0 = F.try_variant_get(r, f"$[{j}][0]", "variant")
    cell = F.try_variant_get(r, f"$[{j}]", "variant")
    return F.when(item0.isNotNull(), py_str(item0)).otherwise(py_str(cell))


def bind_deficiency_types(landing: DataFrame, row_col: str = "row") -> DataFrame:
    """PRJ-4 + FLT-1 + FLT-2 + WIN-1 over ragged (VARIANT) rows.

    A cell that is an array gives its item 0, a scalar cell gives itself,
    a missing cell ''. ``row_index`` is the 1-based position in the raw page,
    taken before the filters, so dropped rows leave gaps.
    """
    r = F.col(row_col)
    n = F.size(F.try_variant_get(r, "$", "array<variant>"))
    cols = [F.coalesce(clean_cell(_cell_value(r, j)), F.lit("")).alias(h)
            for j, h in enumerate(DEFICIENCY_TYPE_HEADERS)]
    out = (once(landing, row_col).filter(n >= MIN_CELLS["deficiency_types"])
           .select(*_keys(landing), *cols, (F.col("row_no") + 1).cast("bigint").alias("row_index")))
    return required_nonempty(out, "Type Code")


def bind_generic(landing: DataFrame, row_col: str = "row",
                 headers: Sequence[str] = DEFICIENCY_TYPE_HEADERS) -> DataFrame:
    """PRJ-5: an object row is kept as it is, an array row is bound to
    ``headers`` (only ``&nbsp;`` cleaned, FN-2b; missing items ''); any other
    row is skipped. Result: ``record MAP<STRING,STRING>`` + ``row_index``."""
    r = F.col(row_col)
    as_obj = F.try_variant_get(r, "$", "map<string,string>")
    as_arr = F.try_variant_get(r, "$", "array<variant>")
    arr_map = F.map_from_arrays(
        F.array(*[F.lit(h) for h in headers]),
        F.array(*[F.coalesce(clean_entity_only(py_str(F.try_variant_get(r, f"$[{j}]", "variant"))), F.lit(""))
                  for j in range(len(headers))]),
    )
    rec = F.when(as_obj.isNotNull(), as_obj).when(as_arr.isNotNull(), arr_map)
    return (landing.select(*_keys(landing), rec.alias("record"),
                           (F.col("row_no") + 1).cast("bigint").alias("row_index"))
            .filter(F.col("record").isNotNull()))


def bind_schedules(landing: DataFrame, row_col: str = "row") -> DataFrame:
    """PRJ-5b + FLT-1 + FLT-4: row item 1 is the field array; fields past its
    end stay NULL (absent); text is cleaned of ``&nbsp;`` (FN-2b); a row needs
    a Schedule ID or a PWS ID."""
    r = F.col(row_col)
    n = F.size(F.try_variant_get(r, "$", "array<variant>"))
    cols = [clean_entity_only(F.try_variant_get(r, f"$[1][{i}]", "string")).alias(h)
            for i, h in enumerate(SAMPLE_SCHEDULE_HEADERS)]
    out = once(landing, row_col).filter(n >= MIN_CELLS["sample_schedules"]).select(*_keys(landing), *cols)
    return out.filter((F.coalesce(F.col("`Schedule ID`"), F.lit("")) != "")
                      | (F.coalesce(F.col("`PWS ID`"), F.lit("")) != ""))
