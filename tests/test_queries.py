"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from terrasift import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    def text(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str([text(x) for x in v])
        return "null" if v is None or pd.isna(v) else f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", core.queries())
def test_query(spark, duck, name):
    got, want = core.queries()[name](spark, SF).toPandas(), duck.execute(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
