"""Each registered volume query against DuckDB on the smallest tables."""

import duckdb
import pytest

from voxframe.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, db, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = db.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in columns:
        assert (a[c].astype(str) == b[c].astype(str)).all() or (a[c].astype(float) == b[c].astype(float)).all(), c


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_give_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
