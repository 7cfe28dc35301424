"""Every registered query: its plan, and its result against SQL on the smallest data."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from checks import load
from checks.verify import TABLES, table

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
PYTHON = re.compile(r"PythonUDF|ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas|MapInArrow")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def close(got, want):
    """Equal up to one unit in the last of six digits, which rounding halves may differ by."""
    assert len(got) == len(want)
    if got == want:
        return
    coarse = lambda rows: sorted(rows, key=lambda r: repr([round(x, 3) if isinstance(x, float) else x for x in r]))
    for a, b in zip(coarse(got), coarse(want), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and abs(x - y) < 1.5e-6), (a, b)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not PYTHON.search(plan)
    assert "CartesianProduct" not in plan
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        rel = con.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        close(got, table(rel.columns, rel.fetchall()))
    else:
        assert got


def test_entry(spark):
    df = entry_points.entry(spark)
    assert "nrmse" in df.columns and df.count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
