"""Every registered layout query gives the rows of its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lamina.plans import catalog, shape_catalog  # noqa: F401


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_sql(spark, sf_dir, db, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = db.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    got = sorted(repr(tuple(r)) for r in df.select(cols).collect())
    assert got == sorted(map(repr, want.select(",".join(f'"{c}"' for c in cols)).fetchall()))


def test_all_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
