"""Registered queries over the driver tables, each with its DuckDB SQL twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the library operators on
whole tables; ``ORACLE[name]`` is independent SQL over the same tables that
must give the same rows. Queries without an SQL twin (documents, streams
whose value lies in the mechanism) are checked on rows only.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify_extraction_error, digits_or_null, version_compatible
from ..operators import aggregates as agg
from ..operators import bind, dedup, events, filters, migrate, paging, project, rules, windows
from ..session import scratch_path, table
from ..sinks import append_runs, inspection_document, read_csv, records_of, write_csv
from ..sources.schema_files import DatasetRules, FieldRule, load_schema
from ..sources.html import bind_header, html_rows
from .. import streaming
from . import standins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# --------------------------------------------------------------------------
# SQL building blocks (DuckDB), mirroring the stand-in texts.

def _clean_a(x: str) -> str:
    return f"trim(replace(replace({x}, '&nbsp;', ' '), '&nbsp', ' '))"


def _clean_b(x: str) -> str:
    return f"trim(replace(replace(replace({x}, '&nbsp;', ' '), '&nbsp', ' '), ' ;', ' '))"


_WS_RAW = """
  SELECT 'water_systems' AS dataset, 'c0' AS capture_id,
         CAST(c_custkey // 1000 AS BIGINT) + {dp} AS page_no, CAST(c_custkey % 1000 AS BIGINT) + {dr} AS row_no,
         c_mktsegment AS r0,
         CASE WHEN c_nationkey = 0 THEN '&nbsp;' ELSE '&nbsp;WS' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS r1,
         '&nbsp;' || c_name || '&nbsp' AS r2,
         CAST(c_nationkey AS VARCHAR) AS r3,
         substr(c_mktsegment, 1, 1) AS r4,
         lower(c_mktsegment) AS r5,
         CASE WHEN c_acctbal >= 0 THEN {pop} END AS r6,
         CASE WHEN c_acctbal >= 0 THEN 'COUNTY&nbsp;' || CAST(c_nationkey AS VARCHAR) END AS r7
  FROM customer {where}"""

WS_GRID_SQL = ("(" + _WS_RAW.format(dp=0, dr=0, where="",
                                    pop="' ' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) || ' '")
               + "\n  UNION ALL" + _WS_RAW.format(dp=1, dr=1000, where="WHERE c_mktsegment = 'BUILDING'",
                                                  pop="' 0 '") + ")")

WS_BOUND_SQL = f"""
SELECT dataset, capture_id, page_no, row_no,
       {_clean_a('r0')} AS "Activity Status", {_clean_a('r1')} AS "Water System No.",
       {_clean_a('r2')} AS "Name", {_clean_a('r3')} AS "Federal Primary Source",
       {_clean_a('r4')} AS "Federal Type", {_clean_a('r5')} AS "State Type",
       {_clean_a('r6')} AS "Population", {_clean_a('r7')} AS "Principal County Served"
FROM {WS_GRID_SQL} g
WHERE r6 IS NOT NULL AND {_clean_a('r1')} <> ''"""

WS_DEDUP_SQL = f"""
SELECT * FROM ({WS_BOUND_SQL}) b
QUALIFY row_number() OVER (PARTITION BY "Water System No." ORDER BY page_no, row_no) = 1"""

WS_INSPECTION_SQL = f"""
SELECT "Water System No." AS system_number, "Name" AS system_name, "Population" AS population,
       "Principal County Served" AS county, "Activity Status" AS activity_status, "State Type" AS system_type
FROM ({WS_DEDUP_SQL}) d"""

_LE_G = """
  SELECT CAST(s_suppkey // 1000 AS BIGINT) AS page_no, CAST(s_suppkey % 1000 AS BIGINT) AS row_no,
         s_acctbal, s_nationkey,
         CASE WHEN s_acctbal < 0 THEN n_name || '&nbsp;' WHEN s_acctbal > 9000 THEN 'X,Y'
              ELSE n_name || ', ' || s_name || ' ;' END AS c0,
         CASE WHEN s_nationkey < 20 THEN 'IN&nbsp;' ELSE 'OR' END AS c1,
         CASE WHEN s_acctbal < 1000 THEN '&nbsp;' WHEN s_acctbal < 3000 THEN ''
              ELSE 'Org&nbsp;' || CAST(s_nationkey AS VARCHAR) END AS c2,
         CASE WHEN s_acctbal < 2000 THEN '&nbsp' ELSE 'MS&nbsp;' || CAST(s_suppkey AS VARCHAR) END AS c3,
         CASE WHEN s_acctbal < 500 THEN 'bad' ELSE 'MS' || CAST(s_suppkey AS VARCHAR) || 'X' END AS c9
  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

LE_SQL = f"""
WITH g AS ({_LE_G}),
b AS (SELECT *, {_clean_b('c0')} AS info1, {_clean_b('c1')} AS status1
      FROM g WHERE NOT (s_acctbal BETWEEN 5000 AND 5100)),
c AS (SELECT *, {_clean_b('info1')} AS info, {_clean_b('c9')} AS fid FROM b WHERE length(info1) > 3),
d AS (SELECT *, CASE WHEN strpos(info, ',') > 0 THEN trim(split_part(info, ',', 1)) ELSE trim(info) END AS last_name,
             CASE WHEN strpos(info, ',') > 0 THEN trim(substr(info, strpos(info, ',') + 1)) ELSE '' END AS first_name,
             regexp_extract(fid, '^([A-Z]{{2}})([0-9]+)', 1) AS st,
             regexp_extract(fid, '^([A-Z]{{2}})([0-9]+)', 2) AS num
      FROM c)
SELECT 'legal_entities' AS dataset, 'c0' AS capture_id, page_no, row_no,
       CASE WHEN first_name <> '' THEN last_name || ', ' || first_name ELSE last_name END AS "Individual Name",
       {_clean_b('status1')} AS "Status",
       CASE WHEN trim(c2) IN ('&nbsp;', '&nbsp', '') THEN '' ELSE {_clean_b('c2')} END AS "Organization",
       CASE WHEN trim(c3) IN ('&nbsp;', '&nbsp', '') THEN '' ELSE {_clean_b('c3')} END AS "Mail Stop",
       st AS "State Code",
       CASE WHEN st <> '' THEN coalesce(try_cast(num AS BIGINT), 0) ELSE 0 END AS "ID Number"
FROM d"""

DEF_SQL = f"""
WITH p AS (SELECT CAST(p_partkey // 1000 AS BIGINT) AS page_no, CAST(p_partkey % 1000 AS BIGINT) AS row_no,
                  p_size, CASE WHEN p_type = 'PROMO' THEN '&nbsp;' ELSE p_brand END AS r0, p_type AS r1,
                  '&nbsp;' || CAST(p_size AS VARCHAR) AS r2, p_name || '&nbsp' AS r3 FROM part)
SELECT 'deficiency_types' AS dataset, 'c0' AS capture_id, page_no, row_no,
       {_clean_a('r0')} AS "Type Code", {_clean_a('r1')} AS "Default Severity Code",
       {_clean_a('r2')} AS "Default Category Code", {_clean_a('r3')} AS "Description",
       row_no + 1 AS row_index
FROM p WHERE p_size >= 5 AND {_clean_a('r0')} <> ''"""


def ws_bound(spark, sf):
    return bind.bind_water_systems(standins.water_system_grid(spark, sf))


def ws_dedup(spark, sf):
    return dedup.keep_first(ws_bound(spark, sf), ["Water System No."])


def inspection_rules(spark, dataset):
    return load_schema(spark, "inspection_report").rules(dataset)


def legal_entities(spark, sf):
    return bind.bind_legal_entities(standins.legal_entity_grid(spark, sf))


def deficiency_types(spark, sf):
    return bind.bind_deficiency_types(standins.deficiency_rows(spark, sf))


# --------------------------------------------------------------------------
# Flagship: grid pages → bound, cleaned rows → keep-first → inspection schema.

@query("inspection_water_systems", WS_INSPECTION_SQL)
def q_inspection_water_systems(spark, sf):
    return project.project(ws_dedup(spark, sf), inspection_rules(spark, "water_systems"))


@query("grid_normalize", WS_BOUND_SQL)
def q_grid_normalize(spark, sf):
    return ws_bound(spark, sf)


@query("grid_dedup", WS_DEDUP_SQL)
def q_grid_dedup(spark, sf):
    return ws_dedup(spark, sf)


@query("entity_normalize", LE_SQL)
def q_entity_normalize(spark, sf):
    return legal_entities(spark, sf)


@query("type_filter", f"SELECT * FROM ({LE_SQL}) e WHERE \"Status\" = 'IN'")
def q_type_filter(spark, sf):
    return bind.type_filter(legal_entities(spark, sf))


@query("deficiency_rows", DEF_SQL)
def q_deficiency_rows(spark, sf):
    return deficiency_types(spark, sf)


@query("deficiency_inspection", f"""
SELECT "Type Code" AS code, "Default Severity Code" AS typical_severity,
       "Default Category Code" AS typical_category, lower("Description") AS description, row_index
FROM ({DEF_SQL}) d""")
def q_deficiency_inspection(spark, sf):
    d = deficiency_types(spark, sf).drop(*bind.LANDING_KEYS)
    return project.snake_rename(d, project.DEFICIENCY_RENAMES)


@query("dedup_keep_first", """
SELECT p_name, p_partkey, p_brand, p_type, p_size, p_retailprice FROM part
QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1""")
def q_dedup_keep_first(spark, sf):
    p = table(spark, sf, "part").select("p_name", "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return dedup.keep_first(p, ["p_name"], order=["p_partkey"])


@query("dedup_composite", """
SELECT p_name, p_brand, p_partkey, p_size FROM part
QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) = 1""")
def q_dedup_composite(spark, sf):
    p = table(spark, sf, "part").select("p_name", "p_brand", "p_partkey", "p_size")
    return dedup.keep_first(p, ["p_name", "p_brand"], order=["p_partkey"])


EXCLUDE = ["rod", "^blue"]


@query("exclude_patterns", """
SELECT p_partkey, p_name FROM part
WHERE NOT (coalesce(regexp_matches(p_name, 'rod'), false) OR coalesce(regexp_matches(p_name, '^blue'), false))""")
def q_exclude_patterns(spark, sf):
    good = [c.pattern for c in filters.check_patterns(spark, EXCLUDE + ["(?P<n>x)"]) if c.valid]
    return filters.exclude_patterns(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", good)


ENTITY_EXCLUDE = ["NATION_1", "^X"]


@query("exclusion_counts", f"""
SELECT CAST(count(*) FILTER (WHERE regexp_matches("Individual Name", 'NATION_1')
                              OR regexp_matches("Individual Name", '^X')) AS BIGINT) AS excluded_count,
       CAST(count(*) FILTER (WHERE NOT (regexp_matches("Individual Name", 'NATION_1')
                              OR regexp_matches("Individual Name", '^X')) AND trim("Individual Name") = '') AS BIGINT)
         AS empty_name_count,
       CASE WHEN excluded_count > 0 THEN printf('Excluded %d entities using exclusion patterns', excluded_count) END
         AS exclusion_warning,
       CASE WHEN empty_name_count > 0 THEN printf('Found %d entities with empty names', empty_name_count) END
         AS empty_name_warning
FROM ({LE_SQL}) e""")
def q_exclusion_counts(spark, sf):
    e = legal_entities(spark, sf)
    return agg.exclusion_counts(e, ~filters.matches_any("Individual Name", ENTITY_EXCLUDE))


@query("search_params", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
  AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1996-12-31 23:59:59'""")
def q_search_params(spark, sf):
    o = table(spark, sf, "orders")
    o = filters.search(o, {"status": "F", "priority": "1-URGENT", "no_such_field": "x"},
                       {"status": "o_orderstatus", "priority": "o_orderpriority"})
    o = filters.between(o, "o_orderdate", "1995-01-01 00:00:00", "1996-12-31 23:59:59")
    return o.select("o_orderkey", "o_custkey", "o_totalprice")


PART_RULES = DatasetRules("part", (
    FieldRule("p_name", "name_upper", transform="upper"),
    FieldRule("p_brand", "brand_lower", transform="lower"),
    FieldRule("p_type_padded", "type_clean", transform="strip"),
    FieldRule("size_text", "size", "integer", transform="int"),
    FieldRule("p_brand", "brand_num", "integer", transform="int"),
    FieldRule("p_retailprice", "price", "number", transform="float"),
    FieldRule("p_comment", "comment", default_value="n/a"),
    FieldRule("p_partkey", "key", transform="no_such_transform"),
))


@query("schema_project", """
SELECT upper(p_name) AS name_upper, lower(p_brand) AS brand_lower, trim(' ' || p_type || ' ') AS type_clean,
       coalesce(try_cast(trim(' ' || CAST(p_size AS VARCHAR) || ' ') AS BIGINT), 0) AS size,
       coalesce(try_cast(trim(p_brand) AS BIGINT), 0) AS brand_num, p_retailprice AS price,
       'n/a' AS comment, p_partkey AS key
FROM part""")
def q_schema_project(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", "p_name", "p_brand", F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("p_type_padded"),
        F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")).alias("size_text"), "p_retailprice")
    return project.project(p, PART_RULES)


@query("schema_union", """
SELECT * FROM (
  SELECT 'customer' AS data_type, c_custkey AS key, c_name AS name, c_acctbal AS acctbal FROM customer
  UNION ALL BY NAME
  SELECT 'supplier' AS data_type, s_suppkey AS key, s_name AS name, s_acctbal AS acctbal FROM supplier
  UNION ALL BY NAME
  SELECT 'part' AS data_type, p_partkey AS key, p_name AS name, p_size AS size FROM part)""")
def q_schema_union(spark, sf):
    frames = {
        "customer": table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                                                        F.col("c_acctbal").alias("acctbal")),
        "supplier": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
                                                        F.col("s_acctbal").alias("acctbal")),
        "part": table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"),
                                                F.col("p_size").alias("size")),
    }
    return dedup.combine_datasets(frames)


@query("flatten_record", """
SELECT o_orderkey, o_orderstatus AS info_status, o_orderpriority AS info_priority,
       string_agg(CAST(l_linenumber AS VARCHAR), ', ' ORDER BY l_linenumber) AS lines
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey, o_orderstatus, o_orderpriority""")
def q_flatten_record(spark, sf):
    # the nested list is the record's own value (a handful of lines per
    # order here); collect_list runs partial (per map task) then final, and
    # the join is a shuffle join on the order key.
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    o = table(spark, sf, "orders")
    nested = o.join(li, o["o_orderkey"] == li["l_orderkey"], "inner").select(
        "o_orderkey", F.struct(F.col("o_orderstatus").alias("status"),
                               F.col("o_orderpriority").alias("priority")).alias("info"), "lines")
    return project.flatten(nested)


@query("snake_rename", """
SELECT 'P' || CAST(p_partkey AS VARCHAR) AS code, p_brand AS typical_severity, p_type AS typical_category,
       lower('Part ' || p_name) AS description, p_retailprice AS retail_price
FROM part""")
def q_snake_rename(spark, sf):
    p = table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("Type Code"),
        F.col("p_brand").alias("Default Severity Code"), F.col("p_type").alias("Default Category Code"),
        F.concat(F.lit("Part "), F.col("p_name")).alias("Description"), F.col("p_retailprice").alias("Retail Price"))
    return project.snake_rename(p, project.DEFICIENCY_RENAMES)


TYPE_TO_DATASET = {"view": "water_systems", "click": "legal_entities", "signup": "deficiency_types"}


@query("output_keys", """
WITH t AS (SELECT DISTINCT event_type FROM events),
m AS (SELECT event_type, CASE event_type WHEN 'view' THEN 'water_systems' WHEN 'click' THEN 'legal_entities'
                                         WHEN 'signup' THEN 'deficiency_types' ELSE event_type END AS data_type FROM t)
SELECT event_type, data_type,
       CASE WHEN data_type = 'water_systems' THEN 'all_water_systems'
            WHEN data_type IN ('legal_entities', 'sample_schedules', 'deficiency_types') THEN data_type
            ELSE 'all_' || data_type END AS output_key,
       CASE WHEN data_type = 'water_systems' THEN 'all_water_systems'
            WHEN data_type IN ('legal_entities', 'sample_schedules') THEN data_type
            ELSE 'all_' || data_type END AS legacy_key
FROM m""")
def q_output_keys(spark, sf):
    t = table(spark, sf, "events").select("event_type").distinct()
    t = filters.lookup_or_self(t.withColumn("data_type", F.col("event_type")), "data_type", TYPE_TO_DATASET)
    return t.select("event_type", "data_type", project.output_key("data_type").alias("output_key"),
                    project.output_key("data_type", legacy=True).alias("legacy_key"))


ALLOWED_TYPES = ["view", "click", "purchase"]


@query("semi_allowed", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def q_semi_allowed(spark, sf):
    return filters.semi(table(spark, sf, "events").select("event_id", "event_type"), ALLOWED_TYPES, ["event_type"])


@query("anti_offending",
       "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def q_anti_offending(spark, sf):
    req = table(spark, sf, "events").select("event_type").distinct()
    return filters.anti(req, ALLOWED_TYPES, ["event_type"]).orderBy("event_type")


@query("intersect_sorted", """
SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey AS nationkey FROM supplier""")
def q_intersect_sorted(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return dedup.intersect_sorted(a, b)


@query("ordered_distinct", "SELECT event_type, min(event_id) AS first_seq FROM events GROUP BY event_type")
def q_ordered_distinct(spark, sf):
    return dedup.ordered_distinct(table(spark, sf, "events"), "event_type", "event_id")


@query("coverage", """
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey, CAST(coalesce(c.n, 0) AS BIGINT) AS e,
             CASE WHEN o_orderstatus = 'P' THEN ' n/a '
                  ELSE ' ' || CAST(length(o_orderpriority) - 5 AS VARCHAR) || ' ' END AS raw_total
      FROM orders LEFT JOIN c ON l_orderkey = o_orderkey),
t AS (SELECT o_orderkey, e, CASE WHEN regexp_matches(trim(raw_total), '^[0-9]+$')
                                 THEN CAST(trim(raw_total) AS BIGINT) END AS t FROM o)
SELECT o_orderkey, e AS extracted_count, t AS total_available,
       CASE WHEN t IS NOT NULL AND t <> 0
            THEN CAST(round(CAST(e AS DECIMAL(38,6)) * 100 / CAST(t AS DECIMAL(38,6)), 1) AS DOUBLE) END AS coverage_pct,
       CASE WHEN t IS NOT NULL AND t <> 0 THEN
            CASE WHEN e = t THEN 'complete' WHEN e < t THEN 'missing ' || CAST(t - e AS VARCHAR)
                 ELSE 'extra ' || CAST(e - t AS VARCHAR) END END AS coverage_status
FROM t""")
def q_coverage(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf, "orders")
    raw = F.when(F.col("o_orderstatus") == "P", F.lit(" n/a ")).otherwise(
        F.concat(F.lit(" "), (F.length("o_orderpriority") - 5).cast("string"), F.lit(" ")))
    j = o.join(counts, o["o_orderkey"] == counts["l_orderkey"], "left").select(
        "o_orderkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("extracted_count"),
        digits_or_null(raw).alias("total_available"))
    cov = agg.coverage("extracted_count", "total_available")
    return j.select("o_orderkey", "extracted_count", "total_available",
                    cov["coverage_pct"].alias("coverage_pct"), cov["coverage_status"].alias("coverage_status"))


def event_runs(spark, sf):
    """One "run" per event type: order, count, time, success and messages."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("data_type")).agg(
        F.min("event_id").alias("seq"),
        F.count(F.lit(1)).cast("bigint").alias("extracted_count"),
        F.sum(F.col("value").cast("decimal(18,2)")).alias("time_dec"),
        (F.min("value") >= 1).alias("success"),
    ).select("data_type", "seq", "extracted_count", F.col("time_dec").cast("double").alias("extraction_time"),
             "success", F.lit(None).cast("bigint").alias("total_available"),
             F.when(~F.col("success"), F.array(F.concat(F.lit("low value in "), F.col("data_type"))))
             .otherwise(F.array().cast("array<string>")).alias("errors"))


EVENT_RUNS_SQL = """
SELECT event_type AS data_type, min(event_id) AS seq, CAST(count(*) AS BIGINT) AS extracted_count,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS extraction_time, min(value) >= 1 AS success
FROM events GROUP BY event_type"""


@query("batch_summary", f"""
WITH r AS ({EVENT_RUNS_SQL})
SELECT CAST(count(*) AS BIGINT) AS n_runs, CAST(sum(extracted_count) AS BIGINT) AS total_records,
       CAST(sum(CAST(extraction_time AS DECIMAL(18,2))) AS DOUBLE) AS total_time,
       bool_and(success) AS all_success,
       CAST(count(*) FILTER (WHERE success) AS BIGINT) AS n_success,
       CAST(count(*) FILTER (WHERE NOT success) AS BIGINT) AS n_failed,
       coalesce(string_agg('low value in ' || data_type, '; ' ORDER BY seq) FILTER (WHERE NOT success), '')
         AS errors_text,
       CAST(NULL AS BIGINT) AS total_available,
       string_agg(data_type, ',' ORDER BY seq) AS data_types
FROM r""")
def q_batch_summary(spark, sf):
    runs = event_runs(spark, sf).withColumn("extraction_time", F.col("extraction_time").cast("decimal(18,2)"))
    exprs = agg.batch_summary_exprs()
    one = runs.agg(*[c.alias(k) for k, c in exprs.items()])
    return one.select("n_runs", "total_records", F.col("total_time").cast("double").alias("total_time"),
                      "all_success", "n_success", "n_failed",
                      F.array_join("errors", "; ").alias("errors_text"), "total_available",
                      F.array_join("data_types", ",").alias("data_types"))


@query("batch_positions", f"""
WITH r AS ({EVENT_RUNS_SQL})
SELECT data_type, CAST(row_number() OVER (ORDER BY seq) - 1 AS BIGINT) AS batch_index,
       CAST(count(*) OVER () AS BIGINT) AS batch_total,
       CAST(floor(CAST(row_number() OVER (ORDER BY seq) - 1 AS DOUBLE) / count(*) OVER () * 100) AS BIGINT)
         AS batch_progress
FROM r""")
def q_batch_positions(spark, sf):
    runs = event_runs(spark, sf)
    return windows.batch_positions(runs, ["seq"]).select("data_type", "batch_index", "batch_total", "batch_progress")


@query("page_stats", f"""
SELECT dataset, capture_id, CAST(count(DISTINCT page_no) AS BIGINT) AS batches_processed,
       CAST(count(DISTINCT "Water System No.") AS BIGINT) AS unique_found, CAST(count(*) AS BIGINT) AS total_records
FROM ({WS_BOUND_SQL}) b GROUP BY dataset, capture_id""")
def q_page_stats(spark, sf):
    return agg.page_stats(ws_bound(spark, sf), "Water System No.")


EVENT_DAYS_SQL = """
SELECT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day_no,
       strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n,
       arg_min(event_type, event_id) AS first_key
FROM events GROUP BY ALL"""


def event_days(spark, sf):
    e = table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    return e.groupBy(F.unix_date("d").cast("bigint").alias("day_no"),
                     F.date_format("d", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.min_by("event_type", "event_id").alias("first_key"))


@query("running_progress", f"""
WITH d AS ({EVENT_DAYS_SQL}),
c AS (SELECT day, n, CAST(coalesce(sum(n) OVER (ORDER BY day_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS BIGINT) AS rows_before, sum(n) OVER () AS total FROM d)
SELECT day, n, rows_before,
       CAST(least(floor(CAST(rows_before AS DOUBLE) / CAST(total AS DOUBLE) * 100.0), 99) AS BIGINT) AS progress_pct
FROM c""")
def q_running_progress(spark, sf):
    d = event_days(spark, sf)
    total = d.agg(F.sum("n")).scalar()  # scalar subquery: no join
    out = windows.progress(d, "n", "day_no", total)
    return out.select("day", "n", F.col("rows_before").cast("bigint").alias("rows_before"), "progress_pct")


@query("stalled_pages", f"""
WITH d AS ({EVENT_DAYS_SQL})
SELECT d.day_no AS page_no, d.n AS n_rows, d.first_key,
       CASE WHEN p.n IS NULL THEN NULL
            ELSE NOT (d.n IS NOT DISTINCT FROM p.n AND d.first_key IS NOT DISTINCT FROM p.first_key) END AS changed
FROM d LEFT JOIN d p ON p.day_no = d.day_no - 1""")
def q_stalled_pages(spark, sf):
    d = event_days(spark, sf).select(F.lit("events").alias("capture_id"), F.col("day_no").alias("page_no"),
                                     F.col("n").alias("n_rows"), "first_key")
    return windows.stalled_pages(d).select("page_no", "n_rows", "first_key", "changed")


@query("stop_rules", """
WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderkey // 100 AS BIGINT) AS page_no FROM orders),
firsts AS (SELECT o_custkey, min(page_no) AS first_page FROM o GROUP BY o_custkey),
s AS (SELECT page_no, count(*) AS n_valid FROM o GROUP BY page_no),
nw AS (SELECT first_page AS page_no, count(*) AS n_new FROM firsts GROUP BY first_page),
st AS (SELECT s.page_no, s.n_valid, coalesce(nw.n_new, 0) AS n_new FROM s LEFT JOIN nw ON s.page_no = nw.page_no),
stop AS (SELECT min(CASE WHEN n_valid = 0 OR n_new = 0 THEN page_no - 1 WHEN n_valid < 100 THEN page_no END) AS sp FROM st)
SELECT o_orderkey, page_no FROM o, stop WHERE stop.sp IS NULL OR page_no <= stop.sp""")
def q_stop_rules(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey",
        F.floor(F.col("o_orderkey") / 100).cast("bigint").alias("page_no"))
    first = dedup.keep_first(o.select("o_custkey", "page_no"), ["o_custkey"], order=["page_no"])
    n_new = first.groupBy("page_no").agg(F.count(F.lit(1)).alias("n_new"))
    stats = o.groupBy("page_no").agg(F.count(F.lit(1)).alias("n_valid")) \
        .join(n_new, ["page_no"], "left").fillna(0, ["n_new"])
    return windows.honor_stop_rules(o, stats, page_size=100, partition=()).select("o_orderkey", "page_no")


@query("keyset_scan", """
WITH p AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS pos FROM customer),
r AS (SELECT c_name, CAST(CASE WHEN pos < 1000 THEN 0 ELSE (pos - 1) // 999 END AS BIGINT) AS search_no FROM p)
SELECT search_no, min(c_name) AS first_key, max(c_name) AS last_key, CAST(count(*) AS BIGINT) AS n_new
FROM r GROUP BY search_no""")
def q_keyset_scan(spark, sf):
    s = paging.keyset_scan(table(spark, sf, "customer").select("c_name"), "c_name", 1000)
    return windows.continuation_key(s, "c_name", partition=["search_no"], order="c_name")


@query("keyset_page", """
SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#000000500' ORDER BY c_name LIMIT 1000""")
def q_keyset_page(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return paging.keyset_page(c, "c_name", "Customer#000000500", 1000)


@query("offset_page", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS pos FROM orders)
SELECT o_orderkey, CAST(pos // 50 + 1 AS BIGINT) AS page_no, CAST(pos % 50 + 1 AS BIGINT) AS row_in_page
FROM r WHERE pos >= 100 AND pos < 200""")
def q_offset_page(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return paging.offset_page(o, ["o_custkey", "o_orderkey"], 50, start_page=3, max_pages=2) \
        .select("o_orderkey", "page_no", "row_in_page")


@query("preview_n", """
SELECT event_type, event_id, user_id FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 2""")
def q_preview_n(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "user_id")
    return paging.preview(e, 2, ["event_type"], ["event_id"])


@query("top_priority", """
SELECT p_brand, p_name, p_size FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1""")
def q_top_priority(spark, sf):
    return paging.top_by(table(spark, sf, "part"), "p_name", "p_size", ["p_brand"], tie=["p_partkey"])


@query("event_filter", """
SELECT event_id, user_id, value FROM events
WHERE event_type = 'purchase' AND ts > TIMESTAMP '2024-01-15 00:00:00'""")
def q_event_filter(spark, sf):
    e = events.filter_events(table(spark, sf, "events"), event_type="purchase", after="2024-01-15 00:00:00",
                             ts_col="ts")
    return e.select("event_id", "user_id", "value")


@query("event_stats", """
WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
tc AS (SELECT user_id, string_agg(event_type || '=' || CAST(n AS VARCHAR), ';' ORDER BY event_type) AS type_counts
       FROM t GROUP BY user_id)
SELECT e.user_id, CAST(count(*) AS BIGINT) AS total_events,
       strftime(arg_min(ts, event_id), '%Y-%m-%d %H:%M:%S.%f') AS first_ts,
       strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S.%f') AS last_ts,
       any_value(tc.type_counts) AS type_counts
FROM events e JOIN tc ON tc.user_id = e.user_id GROUP BY e.user_id""")
def q_event_stats(spark, sf):
    s = events.event_statistics(table(spark, sf, "events"), seq="event_id", ts_col="ts",
                                severity_col=None, group=["user_id"])
    counts = F.array_join(F.transform(F.map_entries("event_type_counts"),
                                      lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ";")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return s.select("user_id", "total_events", F.date_format("first_event_timestamp", fmt).alias("first_ts"),
                    F.date_format("last_event_timestamp", fmt).alias("last_ts"), counts.alias("type_counts"))


def _event_message():
    return (F.when(F.col("event_type") == "error",
                   F.concat(F.lit("Session lost during Authentication for user "), F.col("user_id").cast("string")))
            .when(F.col("event_type") == "signup", F.concat(F.lit("session expired after "), F.col("props")))
            .when(F.col("event_type") == "click",
                  F.concat(F.lit("PAGINATION stalled at "), F.col("event_id").cast("string")))
            .otherwise(F.concat(F.lit("unexpected "), F.col("event_type"))))


@query("error_classify", """
WITH m AS (SELECT event_id, CASE event_type
             WHEN 'error' THEN 'Session lost during Authentication for user ' || CAST(user_id AS VARCHAR)
             WHEN 'signup' THEN 'session expired after ' || props
             WHEN 'click' THEN 'PAGINATION stalled at ' || CAST(event_id AS VARCHAR)
             ELSE 'unexpected ' || event_type END AS message FROM events)
SELECT event_id, message,
       CASE WHEN lower(message) LIKE '%authentication%' THEN 'authentication_error'
            WHEN lower(message) LIKE '%session%' THEN 'session_error'
            WHEN lower(message) LIKE '%pagination%' THEN 'pagination_error'
            ELSE 'extraction_error' END AS category
FROM m""")
def q_error_classify(spark, sf):
    e = table(spark, sf, "events").select("event_id", _event_message().alias("message"))
    return e.select("event_id", "message", classify_extraction_error("message").alias("category"))


def _required_issues(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels")
    j = d.join(lab, "doc_id", "left")
    return rules.validate(j, [rules.required("quality"), rules.required("toxic")], ["doc_id"])


REQUIRED_SQL = """
SELECT doc_id, 'required:quality' AS rule, 'quality' AS field, 'error' AS severity, 'MISSING_REQUIRED' AS code,
       'is required' AS message
FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL
UNION ALL
SELECT doc_id, 'required:toxic', 'toxic', 'error', 'MISSING_REQUIRED', 'is required'
FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL"""


@query("required_fields", REQUIRED_SQL)
def q_required_fields(spark, sf):
    return _required_issues(spark, sf).select("doc_id", "rule", "field", "severity", "code", "message")


def _url_rule_list():
    return rules.url_rules("url", path_suffix=".html") + [
        rules.matches("url", "^https://", code="NOT_HTTPS", severity="warning", message="is not https")]


def _url_issues(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return rules.validate(p, _url_rule_list(), ["page_id"])


_SCHEME = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)"
_NETLOC = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"

URL_SQL = f"""
SELECT page_id, 'url_required:url' AS rule, 'error' AS severity, 'MISSING_BASE_URL' AS code FROM pages
  WHERE coalesce(url, '') = ''
UNION ALL SELECT page_id, 'url_scheme:url', 'error', 'MISSING_PROTOCOL' FROM pages
  WHERE coalesce(url, '') <> '' AND {_SCHEME} = ''
UNION ALL SELECT page_id, 'url_host:url', 'error', 'MISSING_HOSTNAME' FROM pages
  WHERE coalesce(url, '') <> '' AND {_NETLOC} = ''
UNION ALL SELECT page_id, 'url_protocol:url', 'error', 'INVALID_PROTOCOL' FROM pages
  WHERE coalesce(url, '') <> '' AND lower({_SCHEME}) NOT IN ('http', 'https')
UNION ALL SELECT page_id, 'url_localhost:url', 'warning', NULL FROM pages
  WHERE coalesce(url, '') <> '' AND contains({_NETLOC}, 'localhost')
    AND regexp_extract({_NETLOC}, ':([0-9]+)$', 1) = ''
UNION ALL SELECT page_id, 'url_path:url', 'warning', NULL FROM pages
  WHERE coalesce(url, '') <> '' AND NOT ends_with(regexp_replace(url, '/+$', ''), '.html')
UNION ALL SELECT page_id, 'matches:url', 'warning', 'NOT_HTTPS' FROM pages
  WHERE coalesce(url, '') <> '' AND NOT regexp_matches(url, '^https://')"""


@query("url_rules", URL_SQL)
def q_url_rules(spark, sf):
    return _url_issues(spark, sf).select("page_id", "rule", "severity", "code")


# Warning texts of the source's range checks (batch size and
# timeout tiers).
BATCH_WARN = [(10000, "a batch of %d rows strains memory"),
              (5000, "a batch of %d rows is slow to arrive")]
TIMEOUT_ABOVE = [(300000, "a limit of %d ms hides failures")]
TIMEOUT_BELOW = [(1000, "a limit of %d ms ends slow answers")]


def _lineitem_limits(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 200).cast("bigint").alias("batch_size"),
        F.floor("l_extendedprice").cast("bigint").alias("timeout_ms"))


def _range_rules():
    return rules.int_tiers("batch_size", 1, BATCH_WARN, integral=True) + rules.int_tiers(
        "timeout_ms", None, TIMEOUT_ABOVE, warn_below=TIMEOUT_BELOW, integral=True)


def _range_issues(spark, sf, with_broken_rule=False):
    custom = {"broken_rule": lambda d: d.select("no_such_column")} if with_broken_rule else None
    return rules.run_rules(_lineitem_limits(spark, sf), _range_rules(), ["l_orderkey", "l_linenumber"], custom)


RANGE_SQL = """
WITH li AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 200 AS BIGINT) AS b,
                   CAST(floor(l_extendedprice) AS BIGINT) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, 'min:batch_size' AS rule, 'error' AS severity, 'must be at least 1' AS message
  FROM li WHERE b < 1
UNION ALL SELECT l_orderkey, l_linenumber, 'above:batch_size:10000', 'warning',
  printf('a batch of %d rows strains memory', b) FROM li WHERE b > 10000
UNION ALL SELECT l_orderkey, l_linenumber, 'above:batch_size:5000', 'warning',
  printf('a batch of %d rows is slow to arrive', b)
  FROM li WHERE b > 5000 AND b <= 10000
UNION ALL SELECT l_orderkey, l_linenumber, 'above:timeout_ms:300000', 'warning',
  printf('a limit of %d ms hides failures', t) FROM li WHERE t > 300000
UNION ALL SELECT l_orderkey, l_linenumber, 'below:timeout_ms:1000', 'warning',
  printf('a limit of %d ms ends slow answers', t) FROM li WHERE t < 1000"""


@query("range_rules", RANGE_SQL)
def q_range_rules(spark, sf):
    return _range_issues(spark, sf).select("l_orderkey", "l_linenumber", "rule", "severity", "message")


def _customer_rules():
    return [rules.min_length("c_name", 2, code="INVALID_USERNAME_LENGTH"),
            rules.matches("c_name", "^[a-zA-Z0-9_.-]+$", code="INVALID_USERNAME_FORMAT"),
            rules.not_in("c_mktsegment", ["BUILDING"], code="COMMON_VALUE")]


def _part_rules():
    return [rules.matches("p_brand", r"^\d{7,8}$", code="PWS_ID_FORMAT", severity="warning",
                          message="doesn't match typical format (7-8 digits)")]


def _pattern_issues(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_mktsegment")
    ci = rules.validate(c, _customer_rules(), ["key"]).withColumn("source", F.lit("customer"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_brand")
    pi = rules.validate(p, _part_rules(), ["key"]).withColumn("source", F.lit("part"))
    return ci.unionByName(pi)


PATTERN_SQL = """
SELECT c_custkey AS key, 'customer' AS source, 'min_length:c_name' AS rule, 'error' AS severity,
       'INVALID_USERNAME_LENGTH' AS code FROM customer WHERE coalesce(c_name, '') <> '' AND length(c_name) < 2
UNION ALL SELECT c_custkey, 'customer', 'matches:c_name', 'error', 'INVALID_USERNAME_FORMAT' FROM customer
  WHERE coalesce(c_name, '') <> '' AND NOT regexp_matches(c_name, '^[a-zA-Z0-9_.-]+$')
UNION ALL SELECT c_custkey, 'customer', 'not_in:c_mktsegment', 'warning', 'COMMON_VALUE' FROM customer
  WHERE c_mktsegment IN ('BUILDING')
UNION ALL SELECT p_partkey, 'part', 'matches:p_brand', 'warning', 'PWS_ID_FORMAT' FROM part
  WHERE coalesce(p_brand, '') <> '' AND NOT regexp_matches(p_brand, '^[0-9]{7,8}$')"""


@query("pattern_rules", PATTERN_SQL)
def q_pattern_rules(spark, sf):
    return _pattern_issues(spark, sf).select("key", "source", "rule", "severity", "code")


@query("issue_summary", f"""
WITH i AS (
  SELECT 'lineitem' AS source, severity FROM ({RANGE_SQL}) r
  UNION ALL SELECT 'lineitem', 'error'
  UNION ALL SELECT 'pages', severity FROM ({URL_SQL}) u
  UNION ALL SELECT source, severity FROM ({PATTERN_SQL}) p
  UNION ALL SELECT 'documents', severity FROM ({REQUIRED_SQL}) q)
SELECT source, CAST(count(*) AS BIGINT) AS total_issues,
       CAST(count(*) FILTER (WHERE severity = 'info') AS BIGINT) AS info_count,
       CAST(count(*) FILTER (WHERE severity = 'warning') AS BIGINT) AS warning_count,
       CAST(count(*) FILTER (WHERE severity = 'error') AS BIGINT) AS error_count,
       CAST(count(*) FILTER (WHERE severity = 'critical') AS BIGINT) AS critical_count,
       count(*) FILTER (WHERE severity IN ('error', 'critical')) = 0 AS valid
FROM i GROUP BY source""")
def q_issue_summary(spark, sf):
    # counts only: every table's rules are counted straight from their
    # predicates in one aggregate (no issue rows); the failing custom rule of
    # the runner (VAL-14) adds its one RULE_EXECUTION_ERROR row.
    li = _lineitem_limits(spark, sf)
    broken = rules.run_rules(li, [], ["l_orderkey", "l_linenumber"], {"broken_rule": lambda d: d.select("no_such_column")})
    p = table(spark, sf, "pages").select("page_id", "url")
    c = table(spark, sf, "customer").select("c_name", "c_mktsegment")
    pt = table(spark, sf, "part").select("p_brand")
    docs = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    src = lambda df, name: df.withColumn("source", F.lit(name))
    counts = [
        rules.count_issues(src(li, "lineitem"), _range_rules(), ["source"]),
        rules.issue_summary(src(broken, "lineitem"), ["source"]),
        rules.count_issues(src(p, "pages"), _url_rule_list(), ["source"]),
        rules.count_issues(src(c, "customer"), _customer_rules(), ["source"]),
        rules.count_issues(src(pt, "part"), _part_rules(), ["source"]),
        rules.count_issues(src(docs, "documents"), [rules.required("quality"), rules.required("toxic")], ["source"]),
    ]
    return rules.sum_counts(counts, ["source"])


def _event_configs(spark, sf):
    e = table(spark, sf, "events")
    cfg = F.when(F.col("event_type") == "error",
                 F.regexp_replace("props", "}$", ', "validation_level": "strict"}')).otherwise(F.col("props"))
    return e.select("event_id", cfg.alias("config"))


@query("migrate_defaults", """
WITH c AS (SELECT event_id, CASE WHEN event_type = 'error'
                                 THEN regexp_replace(props, '}$', ', "validation_level": "strict"}')
                                 ELSE props END AS config FROM events)
SELECT event_id, CAST(json_extract(config, '$.k') AS BIGINT) AS k,
       coalesce(json_extract_string(config, '$.validation_level'), 'normal') AS validation_level,
       true AS include_timestamp, '%Y%m%d_%H%M%S' AS timestamp_format, true AS include_data_type
FROM c""")
def q_migrate_defaults(spark, sf):
    m = migrate.default_migrator(json_col="config")
    out = m.migrate(_event_configs(spark, sf), "export_configuration", "1.0.0", "1.1.0")
    return out.select("event_id", F.try_variant_get(F.try_parse_json("config"), "$.k", "bigint").alias("k"),
                      "validation_level", F.col("file_naming_policy.include_timestamp").alias("include_timestamp"),
                      F.col("file_naming_policy.timestamp_format").alias("timestamp_format"),
                      F.col("file_naming_policy.include_data_type").alias("include_data_type"))


@query("latest_version", """
WITH v AS (SELECT event_type AS schema_name, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
s AS (SELECT schema_name, k // 40 AS ma, (k // 4) % 12 AS mi, k % 4 AS pa FROM v)
SELECT schema_name, CAST(ma AS VARCHAR) || '.' || CAST(mi AS VARCHAR) || '.' || CAST(pa AS VARCHAR) AS version,
       ma = 1 AS compatible
FROM s QUALIFY row_number() OVER (PARTITION BY schema_name ORDER BY ma DESC, mi DESC, pa DESC) = 1""")
def q_latest_version(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    v = table(spark, sf, "events").select(F.col("event_type").alias("schema_name"), k.alias("k")).select(
        "schema_name", F.concat_ws(".", F.floor(F.col("k") / 40).cast("string"),
                                   F.pmod(F.floor(F.col("k") / 4), F.lit(12)).cast("string"),
                                   F.pmod("k", F.lit(4)).cast("string")).alias("version"))
    latest = paging.latest_version(v, "schema_name", "version", default=None)
    return latest.select("schema_name", "version",
                         version_compatible("version", F.lit("1.9.0"), F.lit(True)).alias("compatible"))


def _record_sql(cols: dict, source: str, name: str) -> str:
    """Records of one dataset as JSON text with their position in arrival order."""
    pairs = ", ".join(f"'{k}', {v}" for k, v in cols.items())
    return (f"SELECT '{name}' AS data_type, row_number() OVER (ORDER BY page_no, row_no) - 1 AS pos, "
            f"CAST(json_object({pairs}) AS VARCHAR) AS record FROM ({source}) x")


_INSPECTED = {
    "water_systems": ({"system_number": '"Water System No."', "system_name": '"Name"', "population": '"Population"',
                       "county": '"Principal County Served"', "activity_status": '"Activity Status"',
                       "system_type": '"State Type"'}, WS_DEDUP_SQL),
    "legal_entities": ({"entity_name": '"Individual Name"', "status": '"Status"', "organization": '"Organization"',
                        "state_code": '"State Code"', "mail_stop": '"Mail Stop"', "id_number": '"ID Number"'}, LE_SQL),
    "deficiency_types": ({"code": '"Type Code"', "typical_severity": '"Default Severity Code"',
                          "typical_category": '"Default Category Code"', "description": '"Description"'}, DEF_SQL)}


@query("inspection_document", "\nUNION ALL ".join(_record_sql(c, q, n) for n, (c, q) in _INSPECTED.items()))
def q_inspection_document(spark, sf):
    """Every record of the inspection document with its place in its list."""
    schema = load_schema(spark, "inspection_report")
    frames = {"deficiency_types": deficiency_types(spark, sf), "legal_entities": legal_entities(spark, sf),
              "water_systems": ws_dedup(spark, sf)}
    names = list(project.transform_datasets(frames, schema, "inspection"))  # PRJ-8..10: which, in what order
    # project each dataset but keep its arrival order for the document lists
    ordered = {k: frames[k].select("page_no", "row_no", *[project.rule_column(frames[k], r)
                                                          for r in schema.rules(k).fields]) for k in names}
    doc = inspection_document(ordered, {k: ["page_no", "row_no"] for k in names})
    return dedup.union_by_name(records_of(doc, 3 * i + 2).select(F.lit(n).alias("data_type"), "pos", "record")
                               for i, n in enumerate(names))


_WS_RECORD = _record_sql({c: f'"{c}"' for c in ("Activity Status", "Water System No.", "Name", "Federal Primary Source",
                                               "Federal Type", "State Type", "Population", "Principal County Served")},
                         WS_DEDUP_SQL, "x")
_STAMP = "strftime((SELECT max(o_orderdate) FROM orders), '%Y-%m-%dT%H:%M:%S')"
_N = f"(SELECT count(*) FROM ({WS_DEDUP_SQL}) n)"
_SUMMARY = (f"'total_extracted', {_N}, 'expected_total', NULL, 'extraction_time', '1.50s', 'timestamp', {_STAMP}, 'success', true")
_REST = "'source_info', json_object('extractor', 'landed_pages'), 'warnings', json_array('sample warning')"


@query("json_envelope", f"""
WITH r AS ({_WS_RECORD}),
k AS (SELECT * FROM (VALUES ('standard', 'all_water_systems'), ('detailed', 'all_water_systems'),
                            ('compact', 'all_water_systems'), ('general', 'all_water_systems'), ('multi', 'water_systems')) v(style, key))
SELECT style, key AS part, pos, record FROM k CROSS JOIN r
UNION ALL SELECT style, 'extraction_summary', 0, CAST(json_object({_SUMMARY}, {_REST}) AS VARCHAR)
FROM k WHERE style IN ('standard', 'detailed')
UNION ALL SELECT 'general', 'extraction_summary', 0,
  CAST(json_object({_SUMMARY}, 'export_mode', 'general', {_REST}) AS VARCHAR)
UNION ALL SELECT 'compact', 'count', 0, CAST({_N} AS VARCHAR)
UNION ALL SELECT 'compact', 'timestamp', 0, '"' || {_STAMP} || '"'
UNION ALL SELECT 'detailed', 'metadata', 0, CAST(json_object(
  'extraction_metadata', json_object('extracted_count', {_N}, 'extraction_time', 1.5, 'data_type', 'water_systems',
    'extraction_timestamp', {_STAMP}, 'total_available', NULL, 'source_info', json_object('extractor', 'landed_pages'),
    'pagination_info', json_object()),
  'result_metadata', json_object('success', true, 'record_count', {_N}, 'has_errors', false, 'has_warnings', true,
    'errors', json_array(), 'warnings', json_array('sample warning'))) AS VARCHAR)
UNION ALL SELECT 'multi', 'extraction_summary', 0, CAST(json_object('total_extracted', {_N}, 'total_available', NULL,
  'data_types', json_array('water_systems'), 'timestamp', {_STAMP}, 'export_mode', 'general') AS VARCHAR)
UNION ALL SELECT 'multi', 'data_type_summaries', 0, CAST(json_object('water_systems',
  json_object('extracted_count', {_N}, 'extraction_time', 1.5, 'success', true)) AS VARCHAR)""")
def q_json_envelope(spark, sf):
    """SNK-6..9 and SNK-12 over projected water systems: every record and
    every summary field of one document per style, by position."""
    from ..sinks import RUNS_SCHEMA, OrderedRecords, general_document, run_document
    recs = ws_dedup(spark, sf).drop("dataset", "capture_id")
    stamp = table(spark, sf, "orders").agg(F.max("o_orderdate")).first()[0]  # one value
    n = recs.count()
    run = spark.createDataFrame([("r", 0, "water_systems", True, n, 1.5, None, stamp, {"extractor": "landed_pages"},
                                  {}, [], ["sample warning"])], RUNS_SCHEMA)
    recs = OrderedRecords(recs, ["page_no", "row_no"])  # ranged and stored once for all five documents
    docs = {s: run_document(recs, run, s) for s in ("standard", "detailed", "compact", "general")}
    docs["multi"] = general_document({"water_systems": recs}, run, timestamp=stamp)
    out = []
    for style, doc in docs.items():
        key = "water_systems" if style == "multi" else "all_water_systems"
        lines = doc.lines()
        out.append(records_of(doc).select(F.lit(style).alias("style"), F.lit(key).alias("part"), "pos", "record"))
        named = F.regexp_extract("line", r'^,"(\w+)": (.*)$', 1)
        out.append(lines.filter(F.col("part") > 3).filter(named != "").select(
            F.lit(style).alias("style"), named.alias("part"), F.col("idx").alias("pos"),
            F.regexp_extract("line", r'^,"(\w+)": (.*)$', 2).alias("record")))
    return dedup.union_by_name(out)


_LE_RECORD = _record_sql(_INSPECTED["legal_entities"][0], LE_SQL, "x")


@query("document_files", f"""
SELECT row_number() OVER (ORDER BY part, idx) - 1 AS pos, line FROM (
  SELECT 0 AS part, 0 AS idx, '{{' AS line UNION ALL SELECT 1, 0, '"water_systems": [' UNION ALL SELECT 3, 0, ']'
  UNION ALL SELECT 2, pos, CASE WHEN pos > 0 THEN ',' ELSE '' END || record FROM ({_WS_RECORD}) a
  UNION ALL SELECT 4, 0, ',"legal_entities": [' UNION ALL SELECT 6, 0, ']'
  UNION ALL SELECT 5, pos, CASE WHEN pos > 0 THEN ',' ELSE '' END || record FROM ({_LE_RECORD}) b
  UNION ALL SELECT 7, 0, ',"count": ' || {_N} UNION ALL SELECT 8, 0, '}}') l""")
def q_document_files(spark, sf):
    """SNK-6..12: every line of a written document of two datasets, its files
    read back in name order as the manifest lists them."""
    from ..sinks import document, read_ordered, write_document
    rules_ = load_schema(spark, "inspection_report").rules("legal_entities").fields
    le = legal_entities(spark, sf)
    order = ["page_no", "row_no"]
    ws = ws_dedup(spark, sf).drop("dataset", "capture_id")
    doc = document(spark, {"water_systems": ws, "legal_entities": le.select(*order, *[project.rule_column(le, r) for r in rules_])},
                   {"count": ws.count()}, {"water_systems": order, "legal_entities": order})
    path = scratch_path(spark, f"document-{uuid.uuid4().hex}")
    write_document(doc, path)
    return windows.global_index(read_ordered(spark, path), ["section", "piece", "block", "at"], out="pos").select("pos", "line")


DOC_SQL = "SELECT doc_id, text, lang, source, n_chars FROM documents"


def _roundtrip(spark, sf, sep):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = scratch_path(spark, f"roundtrip-{uuid.uuid4().hex}")
    write_csv(d, path, sep=sep)
    return read_csv(spark, path, d.schema, sep=sep)


@query("csv_roundtrip", DOC_SQL)
def q_csv_roundtrip(spark, sf):
    return _roundtrip(spark, sf, ",")


@query("tsv_roundtrip", DOC_SQL)
def q_tsv_roundtrip(spark, sf):
    return _roundtrip(spark, sf, "\t")


@query("html_rows", r"""
WITH u AS (SELECT page_id, regexp_extract(html, '(?s)<ul[^>]*>(.*?)</ul>', 1) AS block FROM pages),
l AS (SELECT page_id, regexp_extract_all(block, '(?s)<li[^>]*>(.*?)</li>', 1) AS items FROM u)
SELECT page_id, CAST(unnest(generate_series(0, len(items) - 1)) AS INTEGER) AS row_no,
       trim(regexp_replace(unnest(items), '<[^>]*>', '', 'g')) AS item
FROM l WHERE len(items) >= 2""")
def q_html_rows(spark, sf):
    rows = html_rows(table(spark, sf, "pages"), "html", ["page_id"], container="ul", row="li", cells=())
    return rows.select("page_id", "row_no", F.col("cells")[0].alias("item"))


@query("stream_dedup", "SELECT DISTINCT p_name FROM part")
def q_stream_dedup(spark, sf):
    run = scratch_path(spark, f"stream-dedup-{uuid.uuid4().hex}")
    part = table(spark, sf, "part").select(
        F.floor(F.col("p_partkey") / 1000).cast("bigint").alias("page_no"),
        F.pmod("p_partkey", F.lit(1000)).cast("bigint").alias("row_no"), "p_name", "p_brand")
    part.repartition(4).write.json(run + "/landing")  # landed captures, several files
    out = streaming.ingest_pages(spark, run + "/landing", part.schema, ["p_name"], run + "/sink",
                                 run + "/checkpoint", max_files_per_trigger=2)
    return out.select("p_name")


@query("stream_event_counts", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY ALL""")
def q_stream_event_counts(spark, sf):
    """Many batches: the result is read from one snapshot and the last deltas."""
    run = scratch_path(spark, f"stream-events-{uuid.uuid4().hex}")
    table(spark, sf, "events").repartition(10, "event_id").write.parquet(run + "/events")
    counts = streaming.event_counts(spark, run + "/events", run + "/sink", run + "/checkpoint", delay="3650 days",
                                    max_files_per_trigger=1)
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                         "event_type", "n")


# --------------------------------------------------------------------------
# Landed captures as JSON lines (SRC-1/2, SRC-8): pages written as the grid
# script holds them, read back, exploded, bound.

WS_DENSE_SQL = f"""
WITH g AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_no ORDER BY row_no) - 1 AS BIGINT) AS pos
           FROM {WS_GRID_SQL} x)
SELECT dataset, capture_id, page_no, pos AS row_no,
       {_clean_a('r0')} AS "Activity Status", {_clean_a('r1')} AS "Water System No.",
       {_clean_a('r2')} AS "Name", {_clean_a('r3')} AS "Federal Primary Source",
       {_clean_a('r4')} AS "Federal Type", {_clean_a('r5')} AS "State Type",
       {_clean_a('r6')} AS "Population", {_clean_a('r7')} AS "Principal County Served"
FROM g WHERE r6 IS NOT NULL AND {_clean_a('r1')} <> ''"""


def _landed_captures(spark, sf):
    """Write the water-system grid as captured pages (one JSON line per page,
    rows in page order; a page holds at most the page size plus its overlap),
    return the folder."""
    g = standins.water_system_grid(spark, sf)
    pages = g.groupBy("dataset", "capture_id", "page_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x["cells"]).alias("values"),
        F.count(F.lit(1)).cast("string").alias("total"))
    path = scratch_path(spark, f"captures-{uuid.uuid4().hex}")
    pages.select(F.to_json(F.struct("dataset", "capture_id", "page_no", "total", "values"))).write.text(path)
    return path


@query("capture_scan", WS_DENSE_SQL)
def q_capture_scan(spark, sf):
    from ..sources import grid
    raw = grid.read_captures(spark, _landed_captures(spark, sf))
    return bind.bind_water_systems(grid.to_strict(grid.explode_rows(raw)))


@query("reported_totals", f"""
SELECT 'water_systems' AS dataset, 'c0' AS capture_id, CAST(count(*) AS BIGINT) AS total_available
FROM {WS_GRID_SQL} g WHERE page_no = (SELECT min(page_no) FROM {WS_GRID_SQL} h)""")
def q_reported_totals(spark, sf):
    from ..sources import grid
    return grid.reported_totals(grid.read_captures(spark, _landed_captures(spark, sf)))


# Schedules (PRJ-5b, FLT-4, FLT-7): ragged rows whose item 1 is the field list.

def _schedule_rows(spark, sf):
    o = table(spark, sf, "orders")
    pri = F.substring("o_orderpriority", 1, 1)
    fields = [
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.concat(F.lit("S"), F.col("o_orderkey").cast("string"))),
        F.when(F.col("o_totalprice") < 50000, F.lit("")).otherwise(
            F.concat(F.lit("&nbsp;"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"))),
        F.concat(F.lit("F"), pri),
        F.when(pri == "1", F.lit("OT")).when(pri == "2", F.lit("TC")).otherwise(F.lit("NT")),
        F.col("o_orderstatus"), F.concat(F.col("o_custkey").cast("string"), F.lit("&nbsp;")),
        F.lit("MONTHLY"), F.concat(F.lit("G"), pri),
    ]
    full = F.to_json(F.array(*fields))
    short = F.to_json(F.array(*fields[:4]))
    inner = F.when(F.col("o_orderpriority") == "5-LOW", short).otherwise(full)
    text = F.concat(F.lit('["x",'), inner, F.lit("]"))
    k = F.col("o_orderkey")
    return o.select(F.lit("sample_schedules").alias("dataset"), F.lit("c0").alias("capture_id"),
                    F.floor(k / 1000).cast("bigint").alias("page_no"), F.pmod(k, F.lit(1000)).cast("bigint").alias("row_no"),
                    F.parse_json(text).alias("row"))


def _clean_c(x):
    return f"trim(replace({x}, '&nbsp;', ' '))"


SCHEDULE_SQL = f"""
WITH o AS (SELECT o_orderkey, o_orderpriority, substr(o_orderpriority, 1, 1) AS pri,
                  CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'S' || CAST(o_orderkey AS VARCHAR) END AS f0,
                  CASE WHEN o_totalprice < 50000 THEN '' ELSE '&nbsp;' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') END AS f1,
                  o_orderstatus, o_custkey FROM orders),
s AS (SELECT CAST(o_orderkey // 1000 AS BIGINT) AS page_no, CAST(o_orderkey % 1000 AS BIGINT) AS row_no,
             {_clean_c('f0')} AS "Schedule ID", {_clean_c('f1')} AS "PWS ID", {_clean_c("'F' || pri")} AS "Facility ID",
             CASE pri WHEN '1' THEN 'OT' WHEN '2' THEN 'TC' ELSE 'NT' END AS "Schedule Type",
             CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS "Status",
             CASE WHEN o_orderpriority <> '5-LOW' THEN {_clean_c("CAST(o_custkey AS VARCHAR) || '&nbsp;'")} END
               AS "Sample Count",
             CASE WHEN o_orderpriority <> '5-LOW' THEN 'MONTHLY' END AS "Frequency",
             CASE WHEN o_orderpriority <> '5-LOW' THEN 'G' || pri END AS "Analyte Group"
      FROM o)
SELECT 'sample_schedules' AS dataset, 'c0' AS capture_id, * FROM s
WHERE ("Schedule ID" <> '' OR "PWS ID" <> '')"""


@query("schedule_rows", SCHEDULE_SQL)
def q_schedule_rows(spark, sf):
    return bind.bind_schedules(_schedule_rows(spark, sf))


@query("schedule_search", f"""SELECT * FROM ({SCHEDULE_SQL}) s WHERE "Schedule Type" = 'TC'""")
def q_schedule_search(spark, sf):
    from .export import SEARCH_FIELDS
    rows = bind.bind_schedules(_schedule_rows(spark, sf))
    return filters.search(rows, {"schedule_type": "TC", "unknown_param": "1"}, SEARCH_FIELDS["sample_schedules"])


# Source fallback (SRC-4) and largest-array choice (SRC-5), one capture per
# customer: its orders split by status stand for the candidate arrays.

def _source_candidates(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("capture_id")).agg(
        *[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in ("F", "O", "P")])
    arr = F.array(*[F.struct(F.lit(n).alias("source"), F.lit(i).alias("priority"), F.col(s).alias("n_rows"))
                    for i, (n, s) in enumerate([("main", "O"), ("other", "P"), ("table", "F")])])
    return o.select("capture_id", F.explode(arr).alias("c")).select("capture_id", "c.*")


SOURCE_SQL = """
WITH c AS (SELECT o_custkey AS capture_id, count(*) FILTER (WHERE o_orderstatus = 'O') AS n0,
                  count(*) FILTER (WHERE o_orderstatus = 'P') AS n1, count(*) FILTER (WHERE o_orderstatus = 'F') AS n2
           FROM orders GROUP BY o_custkey),
u AS (SELECT capture_id, 'main' AS source, 0 AS priority, n0 AS n_rows FROM c
      UNION ALL SELECT capture_id, 'other', 1, n1 FROM c UNION ALL SELECT capture_id, 'table', 2, n2 FROM c)"""


@query("choose_source", SOURCE_SQL + """
SELECT capture_id, source, priority FROM u WHERE n_rows > 0
QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY priority, source) = 1""")
def q_choose_source(spark, sf):
    from ..sources import grid
    return grid.choose_source(_source_candidates(spark, sf))


@query("largest_array", SOURCE_SQL + """
SELECT capture_id, source AS name, n_rows AS size FROM u WHERE n_rows > 0
QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY n_rows DESC, priority) = 1""")
def q_largest_array(spark, sf):
    from ..sources import grid
    c = _source_candidates(spark, sf).select("capture_id", F.col("source").alias("name"),
                                             F.col("priority").alias("ord"), F.col("n_rows").alias("size"))
    return grid.largest_array(c)


# Configuration records (VAL-2).

@query("config_rules", """
WITH c AS (SELECT event_id, CASE WHEN event_type = 'error'
                                 THEN regexp_replace(props, '}$', ', "validation_level": "strict"}')
                                 ELSE props END AS config FROM events)
SELECT event_id, 'config_required:mode' AS rule, 'error' AS severity, 'MISSING_FIELD' AS code FROM c
  WHERE json_extract(config, '$.mode') IS NULL
UNION ALL SELECT event_id, 'config_deprecated:validation_level', 'warning', 'DEPRECATED_FIELD' FROM c
  WHERE json_extract(config, '$.validation_level') IS NOT NULL
UNION ALL SELECT event_id, 'config_type:validation_level', 'error', 'INVALID_TYPE' FROM c
  WHERE json_extract(config, '$.validation_level') IS NOT NULL
    AND json_type(json_extract(config, '$.validation_level')) <> 'BOOLEAN'""")
def q_config_rules(spark, sf):
    rs = rules.config_rules("config", required_keys=["k", "mode"], deprecated=["validation_level"],
                            properties={"k": {"type": "integer"}, "validation_level": {"type": "boolean"},
                                        "other": {"type": "custom"}}, version="1.1.0")
    return rules.validate(_event_configs(spark, sf), rs, ["event_id"]).select("event_id", "rule", "severity", "code")


# Multi-dataset CSV (SNK-5, SET-3, PRJ-12) written and read back.

@query("multi_csv_roundtrip", """
SELECT 'customer' AS data_type, c_custkey AS key, c_name AS name, c_nationkey AS nationkey FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier""")
def q_multi_csv_roundtrip(spark, sf):
    from ..sinks import multi_dataset_csv
    frames = {"customer": table(spark, sf, "customer").select(F.col("c_custkey").alias("key"),
                                                              F.col("c_name").alias("name"),
                                                              F.col("c_nationkey").alias("nationkey")),
              "supplier": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"),
                                                              F.col("s_name").alias("name"))}
    path = scratch_path(spark, f"multi-{uuid.uuid4().hex}")
    multi_dataset_csv(frames, path)
    return read_csv(spark, path, "data_type string, key bigint, name string, nationkey int")


# Validation report text (AGG-15) per customer record.

@query("validation_report", f"""
WITH p AS ({PATTERN_SQL}),
i AS (SELECT key, rule, severity,
             CASE WHEN severity = 'error' THEN 'Invalid ' || split_part(rule, ':', 2) || ': ' ||
                  CASE rule WHEN 'min_length:c_name' THEN 'must be at least 2 characters long'
                            ELSE 'contains invalid characters' END
                  ELSE 'appears to be a common default' END AS txt
      FROM p WHERE source = 'customer'),
n AS (SELECT *, row_number() OVER (PARTITION BY key, severity ORDER BY rule) AS rn FROM i),
g AS (SELECT key, count(*) FILTER (WHERE severity = 'error') AS ne, count(*) FILTER (WHERE severity = 'warning') AS nw,
             string_agg(printf('  %d. %s', rn, txt), chr(10) ORDER BY rn) FILTER (WHERE severity = 'error') AS el,
             string_agg(printf('  %d. %s', rn, txt), chr(10) ORDER BY rn) FILTER (WHERE severity = 'warning') AS wl
      FROM n GROUP BY key)
SELECT key, CASE WHEN ne = 0 THEN 'No validation errors'
                 ELSE printf('Found %d validation error(s):', ne) || chr(10) || el ||
                      CASE WHEN nw > 0 THEN chr(10) || chr(10) || printf('Warnings (%d):', nw) || chr(10) || wl
                           ELSE '' END END AS summary
FROM g""")
def q_validation_report(spark, sf):
    i = _pattern_issues(spark, sf).filter(F.col("source") == "customer")
    text = F.when(F.col("severity") == "error", agg.error_text(F.col("field"), F.col("message"), F.lit(None)))\
        .otherwise(F.col("message"))
    # issues per record are bounded by the number of rules
    g = i.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("severity", "rule", text.alias("t")))).alias("l"))
    errs = F.transform(F.filter("l", lambda x: x["severity"] == "error"), lambda x: x["t"])
    warns = F.transform(F.filter("l", lambda x: x["severity"] == "warning"), lambda x: x["t"])
    return g.select("key", agg.numbered_summary(errs, warns).alias("summary"))


# JSON lines sink read back (FN-22 row serialization).

LE_DEDUP_SQL = f"""SELECT * FROM ({LE_SQL}) e
QUALIFY row_number() OVER (PARTITION BY "Individual Name" ORDER BY page_no, row_no) = 1"""


@query("json_lines_roundtrip", LE_DEDUP_SQL)
def q_json_lines_roundtrip(spark, sf):
    from ..sinks import write_json_lines
    le = dedup.keep_first(legal_entities(spark, sf), ["Individual Name"])
    path = scratch_path(spark, f"jsonl-{uuid.uuid4().hex}")
    write_json_lines(le, path)
    return spark.read.schema(le.schema).json(path)


# End-to-end configured export (PIP-1..3, PIP-6, PRJ-19, SNK-13, SNK-15).

_N_WS, _N_LE = f"(SELECT count(*) FROM ({WS_DEDUP_SQL}) a)", f"(SELECT count(*) FROM ({LE_DEDUP_SQL}) b WHERE NOT contains(\"Individual Name\", 'NATION_1'))"
_OUT_LE = f"(SELECT count(*) FROM ({LE_DEDUP_SQL}) b WHERE contains(\"Individual Name\", 'NATION_1'))"
_CUSTOMERS = "(SELECT count(*) FROM customer)"


@query("export_run", f"""
SELECT 'water_systems' AS data_type, 0 AS batch_index, true AS success, CAST({_N_WS} AS BIGINT) AS extracted_count,
       CAST({_CUSTOMERS} AS BIGINT) AS total_available, CAST({_N_WS} AS VARCHAR) AS records,
       CAST((SELECT count(DISTINCT page_no) FROM {WS_GRID_SQL} g) AS VARCHAR) AS pages,
       {_N_WS} || ' records extracted, the source reported ' || {_CUSTOMERS} AS warnings
UNION ALL SELECT 'legal_entities', 1, true, CAST({_N_LE} AS BIGINT), NULL, CAST({_N_LE} AS VARCHAR),
       CAST((SELECT count(DISTINCT page_no) FROM ({LE_SQL}) g) AS VARCHAR),
       CASE WHEN {_OUT_LE} > 0 THEN 'Excluded ' || {_OUT_LE} || ' records by exclusion patterns' ELSE '' END
UNION ALL SELECT 'deficiency_types', 2, true, CAST(count(*) AS BIGINT), NULL, CAST(count(*) AS VARCHAR),
       CAST(count(DISTINCT page_no) AS VARCHAR), '' FROM ({DEF_SQL}) c
UNION ALL SELECT 'sample_schedules', 3, false, 0, NULL, NULL, NULL, ''""")
def q_export_run(spark, sf):
    """Run rows with totals, page facts and warnings; one dataset has no landing."""
    from . import export as ex
    run = scratch_path(spark, f"export-{uuid.uuid4().hex}")
    landings = {"water_systems": standins.water_system_grid(spark, sf),
                "legal_entities": standins.legal_entity_grid(spark, sf),
                "deficiency_types": standins.deficiency_rows(spark, sf)}
    cfg = ex.ExportConfiguration((*landings, "sample_schedules"), "general", "csv", output_path=run + "/out/export.csv",
                                 filters={"legal_entities": {"exclusion_patterns": ["NATION_1"]}})
    totals = table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("total_available")).withColumn("dataset", F.lit("water_systems"))
    res = ex.export(spark, cfg, landings, events_path=run + "/events", totals=totals)
    append_runs(res["runs"], run + "/runs")
    runs = spark.read.parquet(run + "/runs")
    return runs.select("data_type", F.col("source_info")["batch_index"].cast("int").alias("batch_index"),
                       "success", "extracted_count", "total_available", F.col("pagination_info")["records"].alias("records"),
                       F.col("pagination_info")["pages"].alias("pages"), F.array_join("warnings", "; ").alias("warnings"))


@query("report_failure", f"""
SELECT 'run' AS kind, 'water_systems' AS name, true AS ok, CAST(count(*) AS BIGINT) AS n FROM ({WS_DEDUP_SQL}) a
UNION ALL SELECT 'run', 'deficiency_types', false, 0
UNION ALL SELECT 'document', 'water_systems', true, CAST(count(*) AS BIGINT) FROM ({WS_DEDUP_SQL}) a
UNION ALL SELECT 'event', 'export_started', true, 1
UNION ALL SELECT 'event', 'export_completed without deficiency_types', false, 1""")
def q_report_failure(spark, sf):
    """PIP-4: an inspection report of two datasets, one of which fails while
    it is computed: the document holds the other one, both have a run row."""
    from . import export as ex
    from ..sinks import read_ordered
    run = scratch_path(spark, f"report-{uuid.uuid4().hex}")
    broken = standins.deficiency_rows(spark, sf).filter(F.when(F.col("page_no") >= 0, F.raise_error(F.lit("unreadable page")).cast("boolean")))
    cfg = ex.ExportConfiguration(("water_systems", "deficiency_types"), "inspection", "json", output_path=run + "/report")
    res = ex.export(spark, cfg, {"water_systems": standins.water_system_grid(spark, sf), "deficiency_types": broken},
                    events_path=run + "/events")
    runs = res["runs"].select(F.lit("run").alias("kind"), F.col("data_type").alias("name"), F.col("success").alias("ok"),
                              F.col("extracted_count").alias("n"))
    key = F.regexp_extract("line", r'^,?"(\w+)": \[$', 1)
    text = read_ordered(spark, run + "/report")
    record = F.col("line").rlike(r"^,?\{.+\}$")
    doc = text.agg(F.max(key).alias("name"), F.count_if(record).alias("n"), (F.count_if(key != "") == 1).alias("ok")).select(
        F.lit("document").alias("kind"), "name", "ok", "n")
    lost = F.col("context")["failed"]
    named = F.concat("event_type", F.when(lost.isNotNull(), F.concat(F.lit(" without "), lost)).otherwise(""))
    events = spark.read.parquet(run + "/events").groupBy(named.alias("name")).agg(
        F.bool_and(F.col("severity") == "info").alias("ok"), F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("event"))
    return dedup.union_by_name([runs, doc, events])


_WS_FIELDS = ("Activity Status", "Water System No.", "Name", "Federal Primary Source", "Federal Type", "State Type", "Population",
              "Principal County Served")


@query("export_rows", "SELECT " + ", ".join(f"nullif(\"{c}\", '') AS \"{c}\"" for c in _WS_FIELDS) + f" FROM ({WS_DEDUP_SQL}) d")
def q_export_rows(spark, sf):
    """The file that an export wrote, with all of its columns, read back; an
    empty field reads as NULL."""
    from . import export as ex
    run = scratch_path(spark, f"export-{uuid.uuid4().hex}")
    cfg = ex.ExportConfiguration(("water_systems",), "general", "csv", output_path=run + "/out.csv")
    res = ex.export(spark, cfg, {"water_systems": standins.water_system_grid(spark, sf)})
    return read_csv(spark, res["paths"]["water_systems"])


_TWO_CAPTURES_SQL = f"""
SELECT * REPLACE ('c1' AS capture_id) FROM ({WS_BOUND_SQL}) a WHERE "Population" <> '0'
UNION ALL SELECT * REPLACE ('c0' AS capture_id) FROM ({WS_BOUND_SQL}) b"""


def _two_captures(spark, sf):
    rows = ws_bound(spark, sf)
    later = rows.filter(F.col("Population") != "0").withColumn("capture_id", F.lit("c1"))
    return later.unionByName(rows.withColumn("capture_id", F.lit("c0")))


@query("multi_capture_dedup", f"""
SELECT * FROM ({_TWO_CAPTURES_SQL}) t
QUALIFY row_number() OVER (PARTITION BY capture_id, "Water System No." ORDER BY page_no, row_no) = 1""")
def q_multi_capture_dedup(spark, sf):
    return dedup.keep_first(_two_captures(spark, sf), ["dataset", "capture_id", "Water System No."])


_READS_SQL = """
WITH o AS (SELECT o_orderpriority AS capture_id, CAST(o_orderkey // 40 AS BIGINT) AS page_no, CAST(o_orderkey % 40 AS BIGINT) AS row_no,
                  o_custkey % 50 AS k, o_orderstatus = 'F' AND o_orderkey // 40 % 9 = 8 AS blank FROM orders)"""


@query("stop_rules_captures", _READS_SQL + """,
pages AS (SELECT DISTINCT capture_id, page_no FROM o),
v AS (SELECT * FROM o WHERE NOT blank AND NOT (capture_id = '5-LOW' AND page_no = 2)),
f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY capture_id, k ORDER BY page_no, row_no) = 1),
s AS (SELECT p.capture_id, p.page_no, (SELECT count(*) FROM v WHERE v.capture_id = p.capture_id AND v.page_no = p.page_no) AS n_valid,
             (SELECT count(*) FROM f WHERE f.capture_id = p.capture_id AND f.page_no = p.page_no) AS n_new FROM pages p),
stop AS (SELECT capture_id, min(CASE WHEN n_valid = 0 OR n_new = 0 THEN page_no - 1 WHEN n_valid < 4 THEN page_no END) AS sp
         FROM s GROUP BY capture_id)
SELECT f.capture_id, f.page_no, f.row_no, CAST(f.k AS BIGINT) AS k FROM f JOIN stop USING (capture_id)
WHERE sp IS NULL OR f.page_no <= sp""")
def q_stop_rules_captures(spark, sf):
    """Several captures, pages without a valid row, pages without a new key."""
    from .export import page_new_counts
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("capture_id"), F.floor(F.col("o_orderkey") / 40).cast("bigint").alias("page_no"),
        (F.col("o_orderkey") % 40).cast("bigint").alias("row_no"), (F.col("o_custkey") % 50).cast("bigint").alias("k"),
        ((F.col("o_orderstatus") == "F") & (F.floor(F.col("o_orderkey") / 40) % 9 == 8)).alias("blank"))
    valid = o.filter(~F.col("blank") & ~((F.col("capture_id") == "5-LOW") & (F.col("page_no") == 2)))
    kept = dedup.keep_first(valid, ["capture_id", "k"])
    stats = page_new_counts(valid, kept, o, ["capture_id"])
    return windows.honor_stop_rules(kept, stats, 4, ["capture_id"]).select("capture_id", "page_no", "row_no", "k")


@query("capture_issues", """
SELECT CASE event_id % 5 WHEN 0 THEN 'BAD_JSON' WHEN 1 THEN 'NO_VALUES' ELSE 'EMPTY_PAGE' END AS code,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS capture_id,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id AS BIGINT) END AS page_no,
       CASE WHEN event_id % 5 = 0 THEN left(props, length(props) - 1) END AS detail
FROM events WHERE event_id % 5 IN (0, 1, 2)""")
def q_capture_issues(spark, sf):
    from ..sources import grid
    e = table(spark, sf, "events")
    head = F.concat(F.lit('{"capture_id": "'), "event_type", F.lit('", "page_no": '), "event_id")
    kind = F.col("event_id") % 5
    line = (F.when(kind == 0, F.expr("left(props, length(props) - 1)")).when(kind == 1, F.concat(head, F.lit("}")))
            .when(kind == 2, F.concat(head, F.lit(', "values": []}'))).when(kind == 3, F.lit(" "))
            .otherwise(F.concat(head, F.lit(', "values": [[["x"]]]}'))))
    path = scratch_path(spark, f"captures-{uuid.uuid4().hex}")
    e.select(line).write.text(path)
    return grid.capture_issues(spark, path)


@query("fallback_rows", """
WITH p AS (SELECT p_partkey, p_partkey % 4 AS kind, p_brand, p_type, p_name FROM part)
SELECT p_partkey AS page_no, 'main' AS source, 1 AS row_index, p_brand AS code FROM p WHERE kind = 0
UNION ALL SELECT p_partkey, 'wide', 1, p_type FROM p WHERE kind = 1
UNION ALL SELECT p_partkey, 'wide', 2, p_name FROM p WHERE kind = 1
UNION ALL SELECT p_partkey, 'table', 1, p_brand FROM p WHERE kind = 2
UNION ALL SELECT p_partkey, 'table', 2, p_name FROM p WHERE kind = 2""")
def q_fallback_rows(spark, sf):
    """Main array, else the largest other array, else the page's table."""
    from ..sources import grid
    q = lambda c: F.to_json(F.array(c, F.lit("x"), F.lit("y"), F.lit("z")))
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 4).alias("kind"), "p_brand", "p_type", "p_name")
    arrays = (F.when(F.col("kind") == 0, F.concat(F.lit('"main": ['), q(F.col("p_brand")), F.lit('], "wide": [[1], [2]]')))
              .when(F.col("kind") == 1, F.concat(F.lit('"main": [], "thin": [["t"]], "wide": ['), q(F.col("p_type")), F.lit(","),
                                                 q(F.col("p_name")), F.lit("]"))).otherwise(F.lit('"main": []')))
    html = F.concat(F.lit("<table><tr><th>Type Code</th></tr><tr><td>"), "p_brand", F.lit("</td></tr><tr><td>"), "p_name",
                    F.lit("</td></tr></table>"))
    pages = p.select("p_partkey", F.when(F.col("kind") == 2, html).alias("html"), F.parse_json(F.concat(
        F.lit('{"page_no": '), "p_partkey", F.lit(', "capture_id": "c0", '), arrays, F.lit("}"))).alias("page"))
    rows = grid.fallback_rows(pages, ["main", "thin", "wide"])
    bound = bind.bind_generic(rows.drop("capture_id").withColumnRenamed("source", "capture_id"))  # carried as a landing key
    arrays_out = bound.select("page_no", F.col("capture_id").alias("source"), F.col("row_index").cast("int").alias("row_index"),
                              F.col("record")["Type Code"].alias("code"))
    tables = bind_header(html_rows(pages.filter("html is not null").select("p_partkey", "html"), "html", ["p_partkey"]),
                         ["p_partkey", "table_no"])
    return arrays_out.unionByName(tables.select(F.col("p_partkey").alias("page_no"), F.lit("table").alias("source"), "row_index",
                                                F.col("record")["Type Code"].alias("code")))


# HTML tables rendered from lineitem, one page per order, parsed back by the
# table scans (SRC-6, SRC-7, PRJ-5c, WIN-1). A page holds its order's lines
# (a handful here: 4 on average); the per-order list is a partial + final
# aggregate, and a page is by definition one value.

def _order_pages(spark, sf, table_class: str, short_flag: str | None = None):
    # dealt by order before the markup is made: small rows move, and a page's parsing, which costs far more than its
    # bytes tell, is spread over all partitions (a fixed number is not merged by size)
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    td = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    cells = F.concat(td(F.concat(F.lit(" "), F.col("l_linenumber").cast("string"), F.lit(" "))),
                     td(F.col("l_returnflag")),
                     td(F.concat(F.lit("<b>"), F.col("l_linestatus"), F.lit("</b>&amp;x"))))
    if short_flag:
        cells = F.when(F.col("l_returnflag") == short_flag, td(F.col("l_linenumber").cast("string"))).otherwise(cells)
    row = F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))
    pages = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(
        F.struct("l_linenumber", "l_returnflag", "l_linestatus", row.alias("r")))).alias("rs"))
    html = F.concat(F.lit('<html><body><table class="nav"><tr><td>menu</td></tr></table>'),
                    F.lit(f'<table class="{table_class}"><tr><th>Line</th><th>Flag</th><th>Status</th></tr>'),
                    F.array_join(F.transform("rs", lambda x: x["r"]), ""), F.lit("</table></body></html>"))
    return pages.select(F.col("l_orderkey").alias("page_id"), html.alias("html"))


@query("html_tables", """
SELECT l_orderkey AS page_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) AS INTEGER)
         AS row_index,
       CAST(l_linenumber AS VARCHAR) AS line, l_returnflag AS flag, l_linestatus || '&x' AS status
FROM lineitem""")
def q_html_tables(spark, sf):
    from ..sources.html import bind_header
    rows = html_rows(_order_pages(spark, sf, "grid"), "html", ["page_id"], min_data_rows=2)
    b = bind_header(rows)
    return b.select("page_id", "row_index", b["record"]["Line"].alias("line"), b["record"]["Flag"].alias("flag"),
                    b["record"]["Status"].alias("status"))


@query("schedule_tables", """
SELECT l_orderkey AS page_id, CAST(l_linenumber AS VARCHAR) AS line, l_returnflag AS flag,
       l_linestatus || '&x' AS status
FROM lineitem WHERE l_returnflag <> 'R'""")
def q_schedule_tables(spark, sf):
    from ..sources.html import SCHEDULE_TABLE_CLASS, schedule_tables
    b = schedule_tables(_order_pages(spark, sf, SCHEDULE_TABLE_CLASS, short_flag="R"))
    return b.select("page_id", b["record"]["Line"].alias("line"), b["record"]["Flag"].alias("flag"),
                    b["record"]["Status"].alias("status"))


# Request checks (VAL-7): one extraction request per event: its dataset name,
# page limit and page size derived from the event's values.

# Limits and texts of the request checks.
MAX_PAGES_WARN = [(100, "%d pages is a long read")]
PAGE_SIZE_WARN = [(5000, "%d rows a page is slow to arrive")]


@query("request_rules", """
WITH r AS (SELECT event_id,
                  CASE event_type WHEN 'view' THEN 'water_systems' WHEN 'click' THEN 'legal_entities'
                                  WHEN 'signup' THEN 'deficiency_types' ELSE event_type END AS data_type,
                  CAST(json_extract(props, '$.k') AS BIGINT) * 2 - 10 AS max_pages,
                  CAST(floor(value * 40) AS BIGINT) AS page_size FROM events)
SELECT event_id, 'allowed:data_type' AS rule, 'error' AS severity, 'unsupported value' AS message FROM r
  WHERE data_type NOT IN ('water_systems', 'legal_entities', 'sample_schedules', 'deficiency_types')
UNION ALL SELECT event_id, 'min:max_pages', 'error', 'must be at least 1' FROM r WHERE max_pages < 1
UNION ALL SELECT event_id, 'above:max_pages:100', 'warning',
  printf('%d pages is a long read', max_pages) FROM r WHERE max_pages > 100
UNION ALL SELECT event_id, 'min:page_size', 'error', 'must be at least 1' FROM r WHERE page_size < 1
UNION ALL SELECT event_id, 'above:page_size:5000', 'warning',
  printf('%d rows a page is slow to arrive', page_size) FROM r WHERE page_size > 5000""")
def q_request_rules(spark, sf):
    from ..sources.schema_files import DATASETS
    e = table(spark, sf, "events")
    req = filters.lookup_or_self(e.withColumn("data_type", F.col("event_type")), "data_type", TYPE_TO_DATASET).select(
        "event_id", "data_type",
        (F.get_json_object("props", "$.k").cast("bigint") * 2 - 10).alias("max_pages"),
        F.floor(F.col("value") * 40).cast("bigint").alias("page_size"))
    rs = [rules.allowed("data_type", list(DATASETS))] + \
        rules.int_tiers("max_pages", 1, MAX_PAGES_WARN, integral=True) + \
        rules.int_tiers("page_size", 1, PAGE_SIZE_WARN, integral=True)
    return rules.validate(req, rs, ["event_id"]).select("event_id", "rule", "severity", "message")


# Captured pages as a stream (STR-1 over the real capture chain), landed in
# three waves: which copy of a re-served row survives depends on arrival, wave
# by wave, inside a wave by page and row.

@query("stream_captures", f"""
SELECT page_no, row_no, "Activity Status", "Water System No.", "Name", "Population", "Principal County Served"
FROM ({WS_DENSE_SQL}) b
QUALIFY row_number() OVER (PARTITION BY "Water System No." ORDER BY (page_no + 1) % 3, page_no, row_no) = 1""")
def q_stream_captures(spark, sf):
    run = scratch_path(spark, f"stream-captures-{uuid.uuid4().hex}")
    pages = spark.read.text(_landed_captures(spark, sf))
    page_no = F.get_json_object("value", "$.page_no").cast("int")
    for wave in range(3):  # every wave lands and is read by the same stream
        pages.filter((page_no + 1) % 3 == wave).write.mode("append").text(run + "/landing")
        out = streaming.ingest_captures(spark, run + "/landing", bind.bind_water_systems, ["Water System No."],
                                        run + "/sink", run + "/checkpoint")
    return out.select("page_no", "row_no", *[F.col(f"`{c}`") for c in (
        "Activity Status", "Water System No.", "Name", "Population", "Principal County Served")])
