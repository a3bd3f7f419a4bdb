"""Every registered query with SQL gives what DuckDB gives on the small tables."""

import math
import os
from glob import glob

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows):
    return sorted([tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, oracle, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    names = sorted(df.columns)
    found = oracle.sql(__spark_entry__.oracle_sql()[name])
    assert names == sorted(found.columns)
    assert plain(tuple(r[c] for c in names) for r in df.collect()) == plain(tuple(r[found.columns.index(c)] for c in names) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
