"""Queries against their SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lanthorn.plans.oracle import ORACLE_SQL
from lanthorn.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else round(x, 6) if isinstance(x, float) else str(x)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    numbers = lambda rows: [tuple(str(float(x)) if isinstance(x, str) and x.lstrip("-").replace(".", "", 1).isdigit() else str(x) for x in r) for r in rows]
    assert sorted(numbers(normal(got))) == sorted(numbers(normal(want)))
    assert len(got)


#: Queries on the whole scan whose values ``test_whole_scan`` holds against plain versions.
WHOLE = {n for n in QUERIES if n.startswith("full_") and n.removeprefix("full_") in QUERIES and n != "full_residual_findings"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - WHOLE))
def test_answers(spark, name):
    """Queries that SQL can't follow have rows."""
    assert len(QUERIES[name](spark, SF).limit(5).collect()) > 0
