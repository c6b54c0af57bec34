"""Queries with SQL against DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

from heddle.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = queries.queries()[name](spark, DATA)
    names = sorted(df.columns)
    made = c.sql(queries.oracle_sql()[name])
    assert sorted(made.columns) == names
    at = [made.columns.index(x) for x in names]
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(tuple(r[i] for i in at) for r in made.fetchall())
