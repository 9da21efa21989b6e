"""Operators that SQL can express, against that SQL in DuckDB on the smallest tables."""

import os
from collections import Counter
from glob import glob

import duckdb
import pytest

from lodestone.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, sql = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == Counter(tuple(plain(dict(zip(sql.columns, r))[c]) for c in columns) for r in sql.fetchall())
