"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from gridlark.fixtures import TABLES
from gridlark.plans import queries_eval, queries_geometry, queries_selection, queries_tables  # noqa: F401
from gridlark.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        return "null" if x is None or x is pd.NA or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    """Queries without SQL give rows of a stable schema."""
    df = QUERIES[name](spark, SF)
    got = df.toPandas()
    assert len(got) and list(got.columns) == df.columns
