"""Every registered query against its DuckDB SQL twin on sf0.001 (the driver
runs the same comparison on sf0.01)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import digest  # noqa: E402
from gridwright.plans.catalog import QUERIES  # noqa: E402
from gridwright.session import TABLES  # noqa: E402

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["system_number", "system_name", "population", "county", "activity_status", "system_type"]
    assert df.count() > 0


def test_every_query_has_a_callable():
    assert set(SQL) <= set(E.queries())
    assert len(E.queries()) >= 45


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, sf_small, name):
    df = E.queries()[name](spark, sf_small)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert len(rows) >= 1
        return
    cur = duck.execute(SQL[name])
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    c1, h1, l1 = digest(df.columns, rows)
    c2, h2, l2 = digest(dcols, drows)
    assert c1 == c2
    assert len(rows) == len(drows)
    assert h1 == h2, (sorted(set(l1) - set(l2))[:3], sorted(set(l2) - set(l1))[:3])
