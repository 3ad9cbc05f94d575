"""Export-schema files (SRC-10) and their rules.

A schema file is a small JSON document that names, per dataset, the output
fields and where they come from. It is configuration, not data: files that
come with the library are package resources, read on the driver; only a URI is
read through Spark, so any file system of the cluster works and no path is
ever looked up on an executor's disk.

What a document may hold is declared once, in ``FORM``; one walk over that
table fills in defaults and gathers every fault, so a bad file is reported
whole instead of fault by fault.
"""

from __future__ import annotations

import json
import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, field
from importlib import resources
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The four datasets and the declared field types.
DATASETS = ("water_systems", "legal_entities", "sample_schedules", "deficiency_types")
FIELD_TYPES = ("string", "number", "integer", "boolean", "date", "array")
SPARK_TYPES = {"string": "string", "number": "double", "integer": "bigint",
               "boolean": "boolean", "date": "date", "array": "array<string>"}

_NEEDED = object()

#: section -> key -> (kind, default); ``_NEEDED`` marks keys without default.
FORM: dict[str, dict[str, tuple[type, Any]]] = {
    "document": {"schema_info": (dict, _NEEDED), "data_types": (dict, _NEEDED)},
    "schema_info": {"name": (str, _NEEDED), "version": (str, "1.0"), "description": (str, _NEEDED)},
    "dataset": {"fields": (dict, {}), "required": (bool, False), "description": (str, None), "include_all_fields": (bool, False)},
    "field": {"source_field": (str, _NEEDED), "output_field": (str, _NEEDED), "field_type": (str, "string"),
              "required": (bool, False), "description": (str, None), "transform": (str, None), "default_value": (object, None)},
}


class SchemaFileError(ValueError):
    """Carries every fault of a file in ``faults``."""

    def __init__(self, faults: list[str] | str):
        self.faults = [faults] if isinstance(faults, str) else faults
        super().__init__("; ".join(self.faults))


@dataclass(frozen=True)
class FieldRule:
    source_field: str
    output_field: str
    field_type: str = "string"
    required: bool = False
    description: str | None = None
    transform: str | None = None
    default_value: Any = None


@dataclass(frozen=True)
class DatasetRules:
    dataset: str
    fields: tuple[FieldRule, ...] = ()
    required: bool = False
    description: str | None = None
    include_all_fields: bool = False


@dataclass(frozen=True)
class ExportSchema:
    name: str
    version: str
    description: str
    datasets: dict = field(default_factory=dict)  # dataset -> DatasetRules (ordered)

    def rules(self, dataset: str) -> DatasetRules | None:
        return self.datasets.get(dataset)


def _section(kind: str, given: Any, at: str, faults: list[str]) -> dict[str, Any]:
    """The declared keys of one section with defaults filled in; faults are
    added to ``faults`` under the place ``at``."""
    if not isinstance(given, dict):
        faults.append(f"{at}: an object is expected")
        given = {}
    out = {}
    for key, (wanted, default) in FORM[kind].items():
        value = given.get(key)
        if value is None:
            if default is _NEEDED:
                faults.append(f"{at}.{key}: missing")
            value = wanted() if default is _NEEDED else default
        elif wanted is dict and not isinstance(value, dict):
            faults.append(f"{at}.{key}: an object is expected")
            value = {}
        elif wanted in (str, bool):
            value = wanted(value)
        out[key] = value
    return out


def _dataset(name: str, given: Any, at: str, faults: list[str]) -> DatasetRules:
    cfg = _section("dataset", given, at, faults)
    declared = {} if cfg["include_all_fields"] else cfg.pop("fields")
    cfg.pop("fields", None)
    rules = [_section("field", f, f"{at}.fields.{k}", faults) for k, f in declared.items()]
    for r in rules:
        if r["field_type"] not in FIELD_TYPES:
            r["field_type"] = FORM["field"]["field_type"][1]
    return DatasetRules(name, tuple(FieldRule(**r) for r in rules), **cfg)


def parse_schema(doc: dict, name: str | None = None) -> ExportSchema:
    """Compile a document. Datasets this library does not know are left out,
    so newer files stay readable, and an unknown field type means text."""
    faults: list[str] = []
    top = _section("document", doc, "$", faults)
    info = _section("schema_info", top["schema_info"], "$.schema_info", faults)
    known = {d: _dataset(d, cfg, f"$.data_types.{d}", faults) for d, cfg in top["data_types"].items() if d in DATASETS}
    if faults:
        raise SchemaFileError(faults)
    return ExportSchema(name or info["name"], info["version"], info["description"], known)


def _texts(spark: SparkSession, place: str) -> Iterator[str]:
    """Text of the file at ``place``: a URI through Spark, a path on the driver,
    a bare name from the package."""
    if "://" in place:
        for row in spark.read.text(place, wholetext=True).toLocalIterator():
            yield row[0]
    elif os.path.basename(place) != place:
        with open(place, encoding="utf-8") as f:
            yield f.read()
    else:
        yield (resources.files("gridwright") / "config" / place).read_text(encoding="utf-8")


def load_schema(spark: SparkSession, name_or_path: str, schema_dir: str | None = None) -> ExportSchema:
    """SRC-10: a schema by name (of the package, or of ``schema_dir``), by
    driver path or by URI; the file's name becomes the schema's name."""
    place = name_or_path if name_or_path.endswith(".json") else f"{name_or_path}.json"
    if schema_dir and not name_or_path.endswith(".json"):
        place = posixpath.join(schema_dir, place)
    try:
        (text,) = _texts(spark, place)
    except Exception as e:  # the file systems have no common "not there" error
        raise SchemaFileError(f"{place}: cannot be read ({e})") from e
    try:
        doc = json.loads(text)
    except json.JSONDecodeError as e:
        raise SchemaFileError(f"{place}: not JSON ({e})") from e
    return parse_schema(doc, posixpath.splitext(posixpath.basename(place))[0])


def rules_frame(spark: SparkSession, schema: ExportSchema) -> DataFrame:
    """The rules as a small table ``(dataset, seq, output_field, source_field,
    field_type, required, transform, default_value)``."""
    rows = []
    for ds, dr in schema.datasets.items():
        for i, r in enumerate(dr.fields):
            rows.append((ds, i, r.output_field, r.source_field, r.field_type, r.required,
                         r.transform, None if r.default_value is None else json.dumps(r.default_value)))
    st = T.StructType([
        T.StructField("dataset", T.StringType()), T.StructField("seq", T.IntegerType()),
        T.StructField("output_field", T.StringType()), T.StructField("source_field", T.StringType()),
        T.StructField("field_type", T.StringType()), T.StructField("required", T.BooleanType()),
        T.StructField("transform", T.StringType()), T.StructField("default_value", T.StringType()),
    ])
    return spark.createDataFrame(rows, st)
