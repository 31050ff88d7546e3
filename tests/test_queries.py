"""Every registered geometry query against its SQL, on the smallest driver tables where they are present."""

import os

import duckdb
import pytest

from tesselon.plans.queries import oracle_sql, queries

DATA = os.environ.get("TESSELON_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "events"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, db, name):
    df = queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    rel = db.sql(oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(dict(zip(rel.columns, r))[c] for c in cols) for r in rel.fetchall()), key=str)
    assert got == want
