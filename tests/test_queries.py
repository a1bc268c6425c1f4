"""Every registered query of the grid engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidegrid.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _rows(rows):
    near = lambda x: round(x, 4) if isinstance(x, float) else x
    return sorted((tuple(near(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    expected = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    got, want = _rows(df.select(*columns).collect()), _rows(expected.select(*[f'"{c}"' for c in columns]).fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-4 for a, b in zip(g, w))


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(catalog.oracle_sql()) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
