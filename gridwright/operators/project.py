"""Schema projection, flattening and renaming (PRJ-6..PRJ-16, PRJ-19).

A rule list compiles to one ``select``: Catalyst prunes the input columns the
rules do not read down to the scan.
"""

from __future__ import annotations

import json
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import quote
from ..functions.text import join_list, snake_name
from ..functions.transforms import apply_transform
from ..sources.schema_files import DATASETS, DatasetRules, ExportSchema, FieldRule

# Fixed value: key order of the inspection document.
INSPECTION_ORDER = ("water_systems", "legal_entities", "sample_schedules", "deficiency_types")


def _literal(v) -> Column:
    if v is None:
        return F.lit(None).cast("string")
    if isinstance(v, (dict, list)):
        return F.lit(json.dumps(v))
    return F.lit(v)


def rule_column(df: DataFrame, r: FieldRule) -> Column:
    """PRJ-6 for one rule: ``transform(record.get(source, default))``.
    The default applies when the source column is absent (FN-11); a present
    NULL stays NULL and skips the transform (FN-10)."""
    if r.source_field in df.columns:
        src = F.col(quote(r.source_field))
        dtype = df.schema[r.source_field].dataType.simpleString()
    else:
        src = _literal(r.default_value)
        dv = r.default_value
        dtype = ("boolean" if isinstance(dv, bool) else "bigint" if isinstance(dv, int)
                 else "double" if isinstance(dv, float) else "string")
    return apply_transform(src, r.transform, dtype).alias(r.output_field)


def project(df: DataFrame, rules: DatasetRules | Sequence[FieldRule] | None,
            typed: bool = False) -> DataFrame:
    """PRJ-6 / PRJ-7: project through the rules in order; input columns not
    in the rules are dropped. No rules, or ``include_all_fields`` → the frame
    unchanged (pass-through, D-3). ``typed=True`` additionally ``try_cast``s
    each output to its declared field type (the source never enforces it)."""
    if rules is None:
        return df
    fields = rules.fields if isinstance(rules, DatasetRules) else tuple(rules)
    if not fields or (isinstance(rules, DatasetRules) and rules.include_all_fields):
        return df
    cols = [rule_column(df, r) for r in fields]
    if typed:
        from ..sources.schema_files import SPARK_TYPES
        cols = [c.try_cast(SPARK_TYPES[r.field_type]).alias(r.output_field) for c, r in zip(cols, fields)]
    return df.select(*cols)


def select_datasets(frames: Mapping[str, DataFrame], selected: Sequence[str] | None = None) -> list[str]:
    """PRJ-8: ``selected or all``; order follows the selection; unknown or
    absent names skipped; ``[]`` means all."""
    names = list(selected) if selected else list(frames)
    return [n for n in names if n in frames and n in DATASETS]


def transform_datasets(frames: Mapping[str, DataFrame], schema: ExportSchema, mode: str,
                       selected: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """PRJ-6..PRJ-10: project every selected dataset. ``inspection`` skips
    datasets without rules (PRJ-9) and orders keys as the inspection document
    does (PRJ-10); ``general`` passes frames through (PRJ-7)."""
    names = select_datasets(frames, selected)
    out: dict[str, DataFrame] = {}
    if mode == "inspection":
        for n in names:
            r = schema.rules(n)
            if r is None or not r.fields:
                continue
            out[n] = project(frames[n], r)
        return {k: out[k] for k in INSPECTION_ORDER if k in out}
    for n in names:
        r = schema.rules(n)
        out[n] = frames[n] if r is None else project(frames[n], r)
    return out


def flatten(df: DataFrame, sep: str = "_", list_sep: str = ", ") -> DataFrame:
    """PRJ-11: nested struct fields become ``parent_child`` columns
    (recursively); arrays become ``', '``-joined text; maps, whose keys are
    not in the schema, become JSON text. A schema walk: no job."""
    cols: list[Column] = []

    def walk(prefix: str, path: Column, dt: T.DataType):
        if isinstance(dt, T.StructType):
            for f in dt.fields:
                walk(f"{prefix}{sep}{f.name}" if prefix else f.name, path[f.name], f.dataType)
        elif isinstance(dt, T.ArrayType):
            cols.append(join_list(path, list_sep).alias(prefix))
        elif isinstance(dt, T.MapType):
            cols.append(F.to_json(path).alias(prefix))
        else:
            cols.append(path.alias(prefix))

    for f in df.schema.fields:
        walk(f.name, F.col(quote(f.name)), f.dataType)
    return df.select(*cols)


def snake_rename(df: DataFrame, mapping: Mapping[str, str] | None = None,
                 lower_fields: Sequence[str] = ("description",)) -> DataFrame:
    """PRJ-13: rename through ``mapping`` with a snake-case fallback (FN-12);
    text in the ``description`` field is lower-cased."""
    mapping = dict(mapping or {})
    cols = []
    for c in df.columns:
        new = mapping.get(c, snake_name(c))
        col = F.col(quote(c))
        if new in lower_fields and isinstance(df.schema[c].dataType, T.StringType):
            col = F.lower(col)
        cols.append(col.alias(new))
    return df.select(*cols)


# Rename presets of the inspection mode, and column subsets
# (PRJ-14, PRJ-15). The general mode renames nothing.
INSPECTION_RENAMES = {
    "water_systems": {"Water System No.": "system_number", "Name": "name",
                      "Activity Status": "activity_status", "Population": "population",
                      "County": "county", "Sources": "sources", "Types": "types"},
    "legal_entities": {"ID Number": "entity_id", "Name": "name", "Status": "status",
                       "Organization": "organization", "State Code": "state_code"},
    "sample_schedules": {"Schedule ID": "schedule_id", "Facility Name": "facility_name",
                         "Analyte Group": "analyte_group", "Frequency": "frequency",
                         "Start Date": "start_date"},
}
INSPECTION_FIELDS = {
    "water_systems": ["system_number", "name", "activity_status", "population", "county",
                      "sources", "types"],
    "legal_entities": ["entity_id", "name", "status", "organization", "state_code"],
    "sample_schedules": ["schedule_id", "facility_name", "analyte_group", "frequency",
                         "start_date"],
}
# Output names of the deficiency fields.
DEFICIENCY_RENAMES = {"Type Code": "code", "Default Severity Code": "typical_severity",
                      "Default Category Code": "typical_category", "Description": "description"}


def rename_for_mode(df: DataFrame, dataset: str, mode: str) -> DataFrame:
    """PRJ-14: rename preset per dataset and mode; general → none."""
    if mode != "inspection":
        return df
    return df.withColumnsRenamed({k: v for k, v in INSPECTION_RENAMES.get(dataset, {}).items()
                                  if k in df.columns})


def subset_for_mode(df: DataFrame, dataset: str) -> DataFrame:
    """PRJ-15: the preset column subset (columns present only)."""
    return df.select(*[quote(c) for c in INSPECTION_FIELDS.get(dataset, []) if c in df.columns])


def output_key(data_type, legacy: bool = False) -> Column:
    """PRJ-16: output key of a dataset; ``water_systems`` →
    ``all_water_systems``, the other three keep their name, anything else
    ``all_<name>``. ``legacy`` is the older list of the plain JSON writers, in
    which ``deficiency_types`` also gets the prefix."""
    c = F.col(quote(data_type)) if isinstance(data_type, str) else data_type
    same = ["legal_entities", "sample_schedules"] + ([] if legacy else ["deficiency_types"])
    return F.when(c == "water_systems", F.lit("all_water_systems")) \
        .when(c.isin(*same), c).otherwise(F.concat(F.lit("all_"), c))


def enrich_provenance(runs: DataFrame, extra: Mapping[str, Column | str], column: str = "source_info") -> DataFrame:
    """PRJ-19: merge provenance entries into a run's ``source_info`` map
    (later entries win)."""
    kv = []
    for k, v in extra.items():
        kv += [F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string")]
    add = F.create_map(*kv)
    base = F.coalesce(F.col(column), F.create_map().cast("map<string,string>")) if column in runs.columns \
        else F.create_map().cast("map<string,string>")
    return runs.withColumn(column, F.map_concat(base, add))
