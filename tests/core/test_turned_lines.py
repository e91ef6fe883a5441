"""Turned blocks are kept as lines, not pixels, and the measures are the same on both."""

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))

from whorl.operators import slanted  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def test_lines_hold_one_row_per_line_and_give_the_same_measures(spark):
    pixels = spark.range(68 * 68).selectExpr("1L as image_id", "cast(id % 68 as int) as x", "cast(id div 68 as int) as y").selectExpr("*", "cast(abs((x * 3 + y) % 26 - 13) * 17 + (x * y) % 29 as int) as v")
    blocks = spark.createDataFrame([(1, 0, 0, 0.3), (1, 1, 1, -0.7)], "image_id long, bx int, by int, theta double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for along, args, measures in (("y", (32, 16, 2, 0.0), (slanted.local_clarity, slanted.uniformity_ratios)), ("x", (16, 32, 2, math.pi / 2), (slanted.frequencies,))):
        lines, long = slanted.turned_lines(pixels, blocks, *args, along).cache(), slanted.turned_blocks(pixels, blocks, *args).cache()
        assert lines.count() == 2 * 32 and long.count() == 2 * 512
        for measure in measures:
            assert rows(measure(lines)) == rows(measure(long)) != []
