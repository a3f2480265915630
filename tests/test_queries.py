"""Every registered radar query against its SQL in DuckDB, on whole tables."""

import os

import duckdb
import pandas as pd
import pytest

from galefold.plans.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def values(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    numbers = {c: df[c].astype("float64") for c in df.columns if str(df[c].dtype).lower().startswith(("int", "float"))}
    rows = (tuple(None if pd.isna(x) else repr(x) if isinstance(x, float) else str(x) for x in r) for r in df.assign(**numbers).itertuples(index=False))
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got) == values(want)
    else:
        assert len(got)
