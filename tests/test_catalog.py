"""Every registered query runs on the smallest data; those with SQL give its rows."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in data], key=str)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql:
        want = con.execute(sql)
        cols = [d[0] for d in want.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows(df.columns, got) == rows(cols, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_subpackage():
    root = os.path.dirname(entry.__file__)
    for f in glob.glob(f"{root}/codequarry/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in f:
            assert "codequarry.llm" not in open(f).read(), f
