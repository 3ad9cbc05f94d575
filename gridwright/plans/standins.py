"""Source-shaped inputs derived from the driver tables.

The driver tables hold none of the source system's datasets, so each query
lays a driver table out in the shape the operators expect: landed grid pages
(``customer`` → water systems, ``supplier`` ⋈ ``nation`` → legal entities),
ragged VARIANT rows (``part`` → deficiency types). Every raw cell text is
built from the row's own values (markup such as ``&nbsp;`` is injected by a
data rule), so the work grows with the tables. The SQL twins in
``catalog.py`` build the same texts.

Page geometry: ``page_no = key div 1000``, ``row_no = key mod 1000``; a
re-served copy of some rows (the overlap a paginated read sees) lands one
page later at ``row_no + 1000``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources.grid import grid_from_table

NB = "&nbsp;"
NB_BARE = "&nbsp"


def _arr(c: Column) -> Column:
    return F.array(c)


def ws_cells(reserved: bool = False) -> list[Column]:
    """Eight grid cells of a water-system row built from a customer row;
    rows with a negative balance land truncated (6 cells)."""
    ok = F.col("c_acctbal") >= 0
    pop = F.lit(" 0 ") if reserved else F.concat(
        F.lit(" "), F.floor("c_acctbal").cast("bigint").cast("string"), F.lit(" "))
    key = F.when(F.col("c_nationkey") == 0, F.lit(NB)).otherwise(
        F.concat(F.lit(NB), F.lit("WS"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")))
    return [
        _arr(F.col("c_mktsegment")),
        _arr(key),
        _arr(F.concat(F.lit(NB), F.col("c_name"), F.lit(NB_BARE))),
        _arr(F.col("c_nationkey").cast("string")),
        _arr(F.substring("c_mktsegment", 1, 1)),
        _arr(F.lower("c_mktsegment")),
        F.when(ok, _arr(pop)),
        F.when(ok, _arr(F.concat(F.lit("COUNTY" + NB), F.col("c_nationkey").cast("string")))),
    ]


def water_system_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed water-system pages from ``customer`` with the overlap copy of
    the ``BUILDING`` rows re-served on the next page."""
    cust = table(spark, sf_dir, "customer")
    base = grid_from_table(cust, "c_custkey", ws_cells(), dataset="water_systems")
    again = grid_from_table(cust.filter(F.col("c_mktsegment") == "BUILDING"), "c_custkey",
                            ws_cells(reserved=True), dataset="water_systems")
    again = again.withColumn("page_no", F.col("page_no") + 1).withColumn("row_no", F.col("row_no") + 1000)
    return base.unionByName(again)


def entity_cells() -> list[Column]:
    """Ten grid cells of a legal-entity row from a supplier row joined to its
    nation; balances in [5000, 5100] land as one-cell rows."""
    bal = F.col("s_acctbal")
    full = ~bal.between(5000, 5100)
    sk = F.col("s_suppkey").cast("string")
    info = (F.when(bal < 0, F.concat(F.col("n_name"), F.lit(NB)))
            .when(bal > 9000, F.lit("X,Y"))
            .otherwise(F.concat(F.col("n_name"), F.lit(", "), F.col("s_name"), F.lit(" ;"))))
    status = F.when(F.col("s_nationkey") < 20, F.lit("IN" + NB)).otherwise(F.lit("OR"))
    org = (F.when(bal < 1000, F.lit(NB)).when(bal < 3000, F.lit(""))
           .otherwise(F.concat(F.lit("Org" + NB), F.col("s_nationkey").cast("string"))))
    mail = F.when(bal < 2000, F.lit(NB_BARE)).otherwise(F.concat(F.lit("MS" + NB), sk))
    fid = F.when(bal < 500, F.lit("bad")).otherwise(F.concat(F.lit("MS"), sk, F.lit("X")))
    cells = [_arr(info)] + [F.when(full, _arr(c)) for c in
                            (status, org, mail, F.lit("x"), F.lit("x"), F.lit("x"), F.lit("x"), F.lit("x"), fid)]
    return cells


def legal_entity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = table(spark, sf_dir, "supplier")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = sup.join(nat, sup["s_nationkey"] == nat["n_nationkey"], "inner")
    return grid_from_table(j, "s_suppkey", entity_cells(), dataset="legal_entities")


def _json_str(c: Column) -> Column:
    esc = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), esc, F.lit('"'))


def deficiency_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged VARIANT rows from ``part``: array cells and scalar cells mixed;
    parts smaller than 5 land as 3-cell rows; PROMO parts have a blank code."""
    # dealt out: a small file is read by one task, and the cells of a row cost far more than its values
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size", "p_name").repartition("p_partkey")
    code = F.when(F.col("p_type") == "PROMO", F.lit(NB)).otherwise(F.col("p_brand"))
    c0 = F.concat(F.lit("["), _json_str(code), F.lit("]"))
    c1 = _json_str(F.col("p_type"))
    c2 = F.concat(F.lit("["), _json_str(F.concat(F.lit(NB), F.col("p_size").cast("string"))), F.lit("]"))
    c3 = _json_str(F.concat(F.col("p_name"), F.lit(NB_BARE)))
    full = F.concat(F.lit("["), c0, F.lit(","), c1, F.lit(","), c2, F.lit(","), c3, F.lit("]"))
    short = F.concat(F.lit("["), c0, F.lit(","), c1, F.lit(","), c2, F.lit("]"))
    text = F.when(F.col("p_size") >= 5, full).otherwise(short)
    k = F.col("p_partkey")
    return part.select(
        F.lit("deficiency_types").alias("dataset"), F.lit("c0").alias("capture_id"),
        F.floor(k / 1000).cast("bigint").alias("page_no"), F.pmod(k, F.lit(1000)).cast("bigint").alias("row_no"),
        F.parse_json(text).alias("row"))
