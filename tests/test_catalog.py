"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare
from wardlog.sources.views import TABLES

DATA = "/root/testdata/sf0.001"

NAMES = sorted(queries())
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = queries()[name](spark, DATA)
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]).startswith("ok")
    else:
        assert df.count() > 0


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(NAMES)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_ratios_are_shares(spark, con):
    rows = queries()["a07_status_ratios"](spark, DATA).collect()
    assert all(0 <= v <= 1 for r in rows for k, v in r.asDict().items() if k.endswith("_st"))
    for r in queries()["a21_hour_ratios"](spark, DATA).collect():
        assert sum(v for k, v in r.asDict().items() if k.startswith("hour_")) == pytest.approx(1)


def test_no_pair_joins(spark, con):
    """Plans hold no cartesian product and no Python stage."""
    for name in ORACLE:
        if name[0] in "st":
            continue
        plan = queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
