"""Coefficient queries run over every part: compared with SQL that reads all of ``part``."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(__file__)))
sys.path.insert(0, ROOT)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from whorl.plans import bridges  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.mark.parametrize("name", ["w14_unquantize", "w16_pixels", "w18_normalize", "w20_variance", "w23_quantize", "w25_zero_runs"])
def test_query_covers_every_part(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view part as select * from '{SF}/part.parquet'")
    want = con.sql(bridges.ORACLES[name].replace(" where p_partkey % 50 = 0", "")).df()
    got = bridges.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    if "p_partkey" in columns:
        assert got["p_partkey"].nunique() == con.execute("select count(*) from part").fetchall()[0][0]
    rows = lambda df: sorted(map(repr, df[columns].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
