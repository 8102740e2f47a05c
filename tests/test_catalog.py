"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows
from glyphloom.catalog import QUERIES

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(ORACLES) >= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    cur = db.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["clip_id", "frame_no", "width", "height", "text"] and df.count() == 500
