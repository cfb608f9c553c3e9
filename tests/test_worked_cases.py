"""Every worked case gives the rows that were worked out by hand."""

import duckdb
import pytest

import worked_cases
from test_oracles import plain


@pytest.mark.parametrize("name", sorted(worked_cases.QUERIES))
def test_worked_case(name, spark, sf):
    df = worked_cases.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = duckdb.sql(worked_cases.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in at) for row in found.fetchall())
    assert sorted(tuple(plain(v) for v in row) for row in df.select(*columns).collect()) == want
