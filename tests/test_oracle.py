"""Every query with SQL, side by side with DuckDB on the smallest data."""

from __future__ import annotations

import os

import duckdb
import pytest

from tempora import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, db, name):
    got, want = catalog.queries()[name](spark, DIR).toPandas(), db.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [sorted(map(repr, x[cols].itertuples(index=False, name=None))) for x in (got, want)]
    assert rows[0] == rows[1]


def test_rows_only(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, DIR).count() == 1000
