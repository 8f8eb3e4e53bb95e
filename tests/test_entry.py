"""Every registered table query against its SQL twin at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    got = sorted((tuple(rounded(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted((tuple(rounded(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 599
