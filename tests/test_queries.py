"""Every query with SQL gives DuckDB's rows."""

import glob
import os

import pytest

import __spark_entry__
from tidemark.plans import catalogue_queries

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def shown(x):
    return "null" if x is None or x != x else repr(float(x)) if isinstance(x, (int, float)) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue_queries.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = __spark_entry__.queries()[name](spark, FOLDER)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted([shown(x) for x in r] for r in got.select(*names).collect()) == sorted([shown(x) for x in r] for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue_queries.QUERIES["filter_in_list"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderstatus" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
    plan = catalogue_queries.QUERIES["param_lookup"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,17)" in plan
