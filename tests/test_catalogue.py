"""Every query against its DuckDB statement on the smallest tables, and the entry points."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from memspan.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, SF)
    columns = sorted(found.columns)
    answer = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(answer.columns) == columns
    order = [answer.columns.index(c) for c in columns]
    wanted = sorted(repr(tuple(row[i] for i in order)) for row in answer.fetchall())
    assert sorted(repr(tuple(row)) for row in found.select(*columns).collect()) == wanted


def test_entry_points(spark):
    assert set(catalogue.queries()) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() >= 0
