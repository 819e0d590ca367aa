"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from symbolpulse.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def show(value):
        if value is None or value != value:
            return "~"
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return repr(float(value) + 0.0)
        return str(value)

    return sorted(tuple(show(row[i]) for i in order) for row in rows)


# Queries of the optional package are tested in a folder of their own.
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in got.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.columns
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical(got.columns, rows) == canonical(columns, result.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
