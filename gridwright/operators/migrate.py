"""Schema migrations between versions (VER-2, VER-3, UDF-3).

A migration is a ``DataFrame -> DataFrame`` function registered for a
``(schema, from, to)`` step. The path between two versions is found on the
driver (breadth-first over the registered steps: any length, which covers the
direct and one-hop paths of the source), then the steps are chained with
``df.transform``: one lazy plan, no job per step.
"""

from __future__ import annotations

from collections import deque
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Migration = Callable[[DataFrame], DataFrame]


class MigrationError(ValueError):
    pass


class Migrator:
    def __init__(self):
        self._steps: dict[str, dict[tuple[str, str], Migration]] = {}

    def register(self, schema: str, from_version: str, to_version: str, fn: Migration) -> None:
        self._steps.setdefault(schema, {})[(from_version, to_version)] = fn

    def path(self, schema: str, from_version: str, to_version: str) -> list[tuple[str, str]]:
        steps = self._steps.get(schema)
        if not steps:
            raise MigrationError(f"{schema}: no migration step is known")
        if (from_version, to_version) in steps:
            return [(from_version, to_version)]
        prev: dict[str, tuple[str, str] | None] = {from_version: None}
        q = deque([from_version])
        while q:
            v = q.popleft()
            for (a, b) in steps:
                if a == v and b not in prev:
                    prev[b] = (a, b)
                    if b == to_version:
                        out = []
                        cur = b
                        while prev[cur] is not None:
                            out.append(prev[cur])
                            cur = prev[cur][0]
                        return out[::-1]
                    q.append(b)
        raise MigrationError(f"{schema}: no chain of steps leads from {from_version} to {to_version}")

    def migrate(self, df: DataFrame, schema: str, from_version: str, to_version: str) -> DataFrame:
        if from_version == to_version:
            return df
        for step in self.path(schema, from_version, to_version):
            df = df.transform(self._steps[schema][step])
        return df


def add_if_absent(df: DataFrame, column: str, default: Column) -> DataFrame:
    """VER-3 building block: add ``column`` when it is absent; when present,
    NULL values keep their NULL (the key exists) — use ``fill_null`` for
    defaulting NULLs."""
    if column in df.columns:
        return df
    return df.withColumn(column, default)


# Defaults added by the export-configuration migration
# 1.0.0 → 1.1.0.
FILE_NAMING_DEFAULT = {"include_timestamp": True, "timestamp_format": "%Y%m%d_%H%M%S",
                       "include_data_type": True}
VALIDATION_LEVEL_DEFAULT = "normal"


def file_naming_default() -> Column:
    return F.struct(F.lit(FILE_NAMING_DEFAULT["include_timestamp"]).alias("include_timestamp"),
                    F.lit(FILE_NAMING_DEFAULT["timestamp_format"]).alias("timestamp_format"),
                    F.lit(FILE_NAMING_DEFAULT["include_data_type"]).alias("include_data_type"))


def export_config_v1_to_v1_1(df: DataFrame) -> DataFrame:
    """VER-3 on typed columns: add ``file_naming_policy`` and
    ``validation_level`` when absent."""
    df = add_if_absent(df, "file_naming_policy", file_naming_default())
    return add_if_absent(df, "validation_level", F.lit(VALIDATION_LEVEL_DEFAULT))


def export_config_v1_to_v1_1_json(json_col: str = "config") -> Migration:
    """VER-3 on per-row JSON configuration documents: a key absent from a
    row's document gets its default (per row, like the dict version). The three
    known keys of a policy are typed in ``file_naming_policy``; the whole object,
    with any other key that a row has, is ``file_naming_policy_all`` (VARIANT)."""
    def step(df: DataFrame) -> DataFrame:
        v = F.try_parse_json(F.col(json_col))
        has_fnp = F.try_variant_get(v, "$.file_naming_policy", "variant").isNotNull()
        has_vl = F.try_variant_get(v, "$.validation_level", "variant").isNotNull()
        fnp = F.when(has_fnp, F.struct(
            F.try_variant_get(v, "$.file_naming_policy.include_timestamp", "boolean").alias("include_timestamp"),
            F.try_variant_get(v, "$.file_naming_policy.timestamp_format", "string").alias("timestamp_format"),
            F.try_variant_get(v, "$.file_naming_policy.include_data_type", "boolean").alias("include_data_type"),
        )).otherwise(file_naming_default())
        vl = F.when(has_vl, F.try_variant_get(v, "$.validation_level", "string")).otherwise(
            F.lit(VALIDATION_LEVEL_DEFAULT))
        own = F.try_variant_get(v, "$.file_naming_policy", "variant")
        whole = F.coalesce(own, F.parse_json(F.to_json(file_naming_default())))
        return (df.withColumn("file_naming_policy", fnp).withColumn("validation_level", vl)
                .withColumn("file_naming_policy_all", whole))
    return step


def default_migrator(json_col: str | None = None) -> Migrator:
    m = Migrator()
    m.register("export_configuration", "1.0.0", "1.1.0",
               export_config_v1_to_v1_1_json(json_col) if json_col else export_config_v1_to_v1_1)
    return m
