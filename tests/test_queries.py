"""Each registered query of the regression engine against its SQL in DuckDB, at the smallest size."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lagwise.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) else float(v)
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
