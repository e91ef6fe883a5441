"""Queries with SQL are compared with DuckDB on the small tables."""

import os

import pytest

from whorl.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda v: None if v is None or v != v else int(v) if hasattr(v, "is_integer") and v.is_integer() else v
    rows = lambda df: sorted(repr([plain(v) for v in r]) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None))
    assert rows(got) == rows(want)
