"""Every catalogue query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from kgspark import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in catalogue.SQL if n not in ("shacl_lessthan", "sparql_group_expression")])  # one key is not unique in these tables
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.SQL[name])
    own = [d[0] for d in found.description]
    assert sorted(own) == names
    theirs = sorted((tuple(plain(r[own.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert mine == theirs


def test_queries_without_sql_run(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.SQL):
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
