"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tracelake.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(catalog.SQL[name])
    assert columns == sorted(want.columns)
    got = rows(df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == rows(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
