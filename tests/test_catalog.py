"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os
from collections import Counter
from glob import glob

import duckdb
import pytest

from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{float(v):.9g}") if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    sql = db.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = Counter(tuple(plain(dict(zip(sql.columns, r))[c]) for c in columns) for r in sql.fetchall())
    assert got == want


def test_names_are_known():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 90


def test_entry():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
