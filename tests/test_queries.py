"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest

from graphloom.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = duck.sql(SQL[name])
    names = sql.columns
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in sql.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitions_do_not_matter(spark, sf, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(map(tuple, QUERIES["cochange_topk"](spark, sf).collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert sorted(map(tuple, QUERIES["cochange_topk"](spark, sf).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
