"""Every registered query with SQL against DuckDB at the smallest size."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if isinstance(v, decimal.Decimal) and v == int(v):
        return str(int(v))
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    r = db.sql(entry.oracle_sql()[name])
    assert cols == sorted(r.columns)
    ours = sorted(tuple(plain(x[c]) for c in cols) for x in df.collect())
    theirs = sorted(tuple(plain(v) for _, v in sorted(zip(r.columns, row, strict=True))) for row in r.fetchall())
    assert ours == theirs


def test_altered_contents_where_ids_repeat(spark, tmp_path):
    c = duckdb.connect()
    c.execute(f"copy (select * replace (event_id % 50 as event_id) from '{SF}/events.parquet') to '{tmp_path}/events.parquet'")
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    theirs = c.sql("select archive, pos, name from (" + entry.oracle_sql()["validate_altered"] + ")").fetchall()
    ours = entry.queries()["validate_altered"](spark, str(tmp_path)).select("archive", "pos", "name").collect()
    assert theirs and sorted(map(tuple, ours)) == sorted(theirs)


def test_entry(spark):
    assert entry.entry(spark).columns and entry.entry(spark).count() > 0
