"""Every query of the engine against its SQL in DuckDB, and its plan for cross joins of tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.9g}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, db, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    cursor = db.execute(SQL[name])
    given = [c[0] for c in cursor.description]
    assert sorted(given) == columns
    want = sorted(str([plain(r[given.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect()) == want
    assert "CartesianProduct" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    """These have exact cases elsewhere; here every row of theirs is computed."""
    df = QUERIES[name](spark, small)
    rows = df.collect()
    assert df.columns and (rows or name == "form_signatures")  # the given pages hold no form; form_census has some
    assert "CartesianProduct" not in df._jdf.queryExecution().toString()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
