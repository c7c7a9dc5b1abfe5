"""Every registered query of the history engine against DuckDB on the smallest tables."""

import math
import os

import pandas as pd
import pytest

from histsearch.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for table in ("conversations", "events", "documents"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda v: "" if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else round(v, 5) if isinstance(v, float) else str(v)
    return sorted(repr(tuple(map(clean, r))) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck.sql(ORACLE_SQL[name]).df())
    else:
        assert len(got)
