"""Codes and tables are held by image: symbols and coefficients are neither shuffled nor decoded twice."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from whorl.operators import entropy  # noqa: E402
from whorl.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def test_only_keys_and_tables_are_shuffled(spark):
    plan = registry.QUERIES["w11_coefficients"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = {re.sub(r"#\d+L?|, \d+$", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)}
    assert "BroadcastExchange" not in plan and keys <= {"s_suppkey", "image_id", "image_id, table"}
    # Once to decode, and the tables for the codes and for the decoder.
    assert plan.count("MapInArrow") == 3


def test_failed_blocks_beside_whole_ones(spark):
    one = lambda symbol: ([1] + [0] * 15, [symbol])
    tables = spark.createDataFrame([(1, 0, *one(9)), (1, 1, *one(181)), (2, 1, *one(9))], "image_id long, table int, counts array<int>, symbols array<int>")
    rows = [(1, 0, b"\x7f", 9), (1, 1, b"\x3f", 2), (1, 2, b"\xff", 1), (2, 0, b"\x7f", 9), (2, 1, b"\x00", 5), (2, 2, b"", 0), (3, 0, None, 0), (3, 1, None, 1)]
    packed = spark.createDataFrame([(i, b, None if d is None else bytearray(d), n) for i, b, d, n in rows], "image_id long, block int, data binary, n int")
    want = {(1, 0, p, 0, None) for p in range(9)} | {(1, 1, p, 1, None) for p in range(2)}
    want |= {(1, 2, None, None, "escape"), (2, 0, None, None, "table"), (2, 1, None, None, "run"), (3, 1, None, None, "table")}
    found = [tuple(r) for r in entropy.coefficients(packed, tables).collect()]
    assert len(found) == len(want) and set(found) == want
