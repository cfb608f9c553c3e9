"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import difflib
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace.functions import text as T
from millrace.plans import documents
from millrace.session import TABLES

QUERIES, ORACLE = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return f"{float(value):.9g}" if type(value).__name__ == "Decimal" else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.sql(ORACLE[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in at) for row in found.fetchall())
    assert sorted(tuple(plain(v) for v in row) for row in df.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLE) if not n.startswith("op") and n != "pipeline"))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and (df.count() > 0 or name == "title_ratio_pairs")  # that one is held against all pairs below


def test_title_pairs_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = documents.titles(spark, sf).select("id", T.normalized(F.col("s")).alias("s")).where("s is not null").collect()
    first = {}
    for r in sorted(rows):
        first.setdefault(r.s, r.id)
    strings = sorted((i, s) for s, i in first.items())
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    close = [(i, a, j, b) for n, (i, a) in enumerate(strings) for j, b in strings[n + 1 :] if 2 * min(len(a), len(b)) >= 0.9 * (len(a) + len(b)) and len(a) + len(b)]
    want = {(i, j) for i, a, j, b in close if max(ratio(a, b), ratio(b, a)) >= 0.9}
    assert {(r.a, r.b) for r in QUERIES["title_ratio_pairs"](spark, sf).collect()} == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
