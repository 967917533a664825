"""The numbered queries that have SQL give the same rows as DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

from unitweave.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in os.listdir(sf):
        con.sql(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{sf}/{table}'")
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(con.sql(ORACLE_SQL[name]).select(*names).fetchall())
