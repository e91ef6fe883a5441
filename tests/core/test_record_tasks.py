"""Transactions are made by so many tasks as their number asks for, however few bytes they have."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from whorl.operators import tiles  # noqa: E402
from whorl.plans import bridges, records  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.mark.parametrize("made", [bridges.order_files, records.card_files])
def test_files_are_spread_by_their_number(spark, monkeypatch, made):
    monkeypatch.setattr(tiles, "PER_TASK", 5000)
    files = made(spark, SF)
    # 1500 orders of 100 made rows each.
    assert files.rdd.getNumPartitions() == 30
