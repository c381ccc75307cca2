"""Every relational query equals its DuckDB SQL on the sf0.001 tables."""
import math

import duckdb
import pandas as pd
import pytest

from tapcast.plans.oracle import all_sql
from tapcast.plans.queries import relational_queries

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(df: pd.DataFrame):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].dt.date
    df = df.astype(object).where(pd.notna(df), None)
    # Compare printed values, so -0.0 and 0.0 count as different (as a
    # text-based hash would).
    out = []
    for r in df.itertuples(index=False):
        out.append(repr(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r)))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = relational_queries()[name](spark, SF)
    got = sdf.toPandas()
    want = duck.execute(all_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _rows(got) == _rows(want[got.columns])
