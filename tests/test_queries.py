"""Every query with SQL gives the same rows in DuckDB."""

import duckdb
import pandas as pd
import pytest

from lumaframe import registry

SF = "/root/testdata/sf0.001"
TABLES = "part lineitem events documents embeddings pages".split()


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if pd.isna(x) else str(int(x) if isinstance(x, float) and x == int(x) else x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    expected = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) and rows(got) == rows(expected)
