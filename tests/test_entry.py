"""The driver's contract: every query and its SQL agree on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from foliospark import catalog

SF = "/root/testdata/sf0.001"
QUERIES = {k: v for c in entry.CATALOGS for k, v in c.QUERIES.items()}
ORACLE_SQL = {k: v for c in entry.CATALOGS for k, v in c.ORACLE_SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*[table.column(n).to_pylist() for n in names], strict=True)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toArrow()) == rows(duck.sql(ORACLE_SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.QUERIES["q_mask_roundtrip"](spark, SF).where("not restored").count() == 0
