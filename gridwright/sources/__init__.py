"""Sources: landed grid pages, HTML tables, export-schema files."""

from .grid import (LANDING_KEYS, choose_source, explode_rows, grid_from_table,
                   largest_array, read_captures, reported_totals, strict_cells, to_strict)
from .html import bind_header, html_rows, parse_tables
from .schema_files import (DATASETS, DatasetRules, ExportSchema, FieldRule, SchemaFileError,
                           load_schema, parse_schema, rules_frame)

__all__ = [n for n in dir() if not n.startswith("_")]
