"""SQL and Spark give the same rows."""
import duckdb
import pytest

from tapcast.llm.queries import ORACLE_SQL, QUERIES

from .cases import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype("object").where(df.notna(), None)
                                 .astype(str).replace(r"\.0$", "", regex=True).values.tolist()))
    assert rows(got) == rows(want)
