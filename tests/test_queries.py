"""Every library query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import tallyforge.portfolio_queries  # noqa: F401
import tallyforge.run_queries  # noqa: F401
from tallyforge.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, (float, np.floating, int, np.integer)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_queries_over_all_rows(spark, duck):
    assert QUERIES["longest_prefix_owner"](spark, SF).count() == duck.execute("select count(*) from orders").fetchone()[0]
    ends = duck.execute("select count(distinct l_suppkey) from lineitem").fetchone()[0]
    assert QUERIES["graph_closure"](spark, SF).count() == ends
