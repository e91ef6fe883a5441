"""Plans that stay sound on larger tables: made pixels are spread over tasks and never sent to the driver."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(__file__)))
sys.path.insert(0, ROOT)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from whorl.operators import tiles  # noqa: E402
from whorl.plans import registry  # noqa: E402

SPREAD = [
    "w19_wavelet",
    "w15_round_trip",
    "q25_features",
    "q25_frequencies",
    "q21_blocks",
    "q28_mean_quality",
    "q22_ridges",
    "q14_mu",
    "q20_flow",
    "q15_otsu",
    "q17_certainty",
    "q3_crop",
    "q19_orientation",
    "w18_raster",
    "w20_subbands",
    "q4_pad",
]
HELD = [
    "q16_coherence",
    "q15_runs",
    "q15_region",
    "q24_uniformity",
    "q23_features",
    "q23_clarity",
    "c9_tolerances",
]


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.mark.parametrize("name", SPREAD)
def test_pixels_are_spread_and_not_broadcast(spark, monkeypatch, name):
    monkeypatch.setattr(tiles, "PER_TASK", 50)
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "BroadcastExchange" not in plan


@pytest.mark.parametrize("name", HELD)
def test_joins_do_not_rely_on_estimated_sizes(spark, name):
    assert "BroadcastExchange" not in registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
