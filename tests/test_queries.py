"""Each engine query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    """Rows as sorted text; whole numbers alike whatever their type."""
    return sorted(tuple("" if x is None else str(int(x)) if isinstance(x, float) and x == int(x) else str(x) for x in r) for r in rows)


def test_all_names_agree():
    assert set(engine.oracle_sql()) <= set(engine.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1500


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query(spark, sql, name):
    got = engine.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = sql.sql(engine.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert plain(map(tuple, got.select(columns).collect())) == plain(sql.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({engine.oracle_sql()[name]})").fetchall())
