"""Scalar functions: ``Column -> Column``, built-in Spark expressions only."""

from .fmt import (classify_extraction_error, classify_output_error, clamp_percent,
                  duration_text, iso_timestamp, merge_maps, row_json, stamp,
                  version_compatible, version_sort_key)
from .parse import (digits_or_null, exact_integer, federal_id, join_name, split_name,
                    to_float_or_zero, to_int_or_zero, to_int_or_zero_text)
from .text import (blank_if_markup, clean_cell, clean_cell_semicolon,
                   clean_entity_only, join_list, py_strip, snake_case,
                   snake_name, title_label)
from .transforms import apply_transform, known_transforms, register_transform

__all__ = [n for n in dir() if not n.startswith("_")]
