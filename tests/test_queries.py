"""Every registered network query against its SQL in DuckDB."""

import numbers

import duckdb
import pandas as pd
import pytest

from conftest import SMALL
from roadloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, float) else v
    return list(df.columns), sorted(str(tuple(float(v) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v) for v in map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, con, name):
    assert rows(catalog.queries()[name](spark, SMALL).toPandas()) == rows(con.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0
