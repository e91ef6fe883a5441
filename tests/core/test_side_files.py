"""Side files are taken apart once each, by as many tasks as their number asks for."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from whorl.operators import tiles  # noqa: E402
from whorl.plans import registry  # noqa: E402
from whorl.sources import files  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def test_side_files_are_spread_and_parsed_once(spark, monkeypatch):
    monkeypatch.setattr(tiles, "PER_TASK", 50)
    plan = registry.QUERIES["s17_side_file"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count("split(") == 1


def test_values_of_odd_side_files(spark):
    texts = {"a": b"NIST_COM 2\r\n PIX_WIDTH\t3 \nPIX_WIDTH 4\n\nPIX_DEPTH x\nPPI\n", "b": b"other\nPIX_WIDTH 3", "c": None, "d": b"", "e": b"NIST_COM 1\nPPI 7 8\nPIX_HEIGHT 9"}
    made = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in texts.items()], "path string, content binary")
    found = {r[0]: tuple(r)[1:] for r in files.side_files(made).collect()}
    none = (None, None, None, 500)
    assert found == {"a": (4, None, None, 500), "b": none, "c": none, "d": none, "e": (None, 9, None, 500)}
