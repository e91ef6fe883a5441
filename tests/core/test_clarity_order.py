"""Widths of a block are added from the first on, however Spark splits its groupings."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from whorl.operators import slanted  # noqa: E402

FALLBACK = "spark.sql.TungstenAggregate.testFallbackStartsAt"


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture(scope="module")
def turned(spark):
    # Ridge widths 2, 3, 3, 3, 4: their mean is the least one that counts if added in this order, and below it as 2 + (3 + 3 + 3 + 4).
    ends = [2, 6, 9, 12, 15, 19, 22, 25, 29]
    stretch = sum((F.when(F.col("x") > end, 1).otherwise(0) for end in ends[1:]), F.when(F.col("x") > ends[0], 1).otherwise(0))
    columns = spark.range(12 * 32).selectExpr("id div 96 as image_id", "cast(id div 32 % 3 as int) as bx", "0 as by", "cast(id % 32 as int) as x")
    return columns.withColumn("v", F.array_repeat(F.when(stretch % 2 == 0, 0).otherwise(200), 16))


def _split(spark, query) -> dict:
    """What ``query`` returns as it is, and where groupings are written out and merged after a few rows."""
    found = {}
    for split in (None, "1, 5", "2, 7"):
        if split:
            spark.conf.set(FALLBACK, split)
        try:
            found[split] = {tuple(r) for r in query().collect()}
        finally:
            spark.conf.unset(FALLBACK)
    return found


def test_clarity_does_not_depend_on_how_sums_are_split(spark, turned):
    found = _split(spark, lambda: slanted.local_clarity(turned).select("value"))
    assert found == {None: {(1.0,)}, "1, 5": {(1.0,)}, "2, 7": {(1.0,)}}


def test_features_do_not_depend_on_how_sums_are_split(spark, turned):
    features = lambda: slanted.block_features(slanted.local_clarity(turned), slanted.CLARITY_BOUNDS, "n").select("n9", F.round("nMean", 6), F.round("nStdDev", 6))
    assert _split(spark, features) == {None: {(3, 1.0, 0.0)}, "1, 5": {(3, 1.0, 0.0)}, "2, 7": {(3, 1.0, 0.0)}}
