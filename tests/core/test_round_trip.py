"""The transform and back is compared where an image lies: only keys are shuffled."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from whorl.operators import wavelets  # noqa: E402
from whorl.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def test_round_trip_shuffles_keys_alone(spark):
    plan = registry.QUERIES["w15_round_trip"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1
    assert "Join" not in plan


def test_round_trip_is_the_transform_and_back(spark):
    rows = [(i, x, y, float((x * 7 + y * 13 + x * y // 3) % 251)) for i, (w, h) in enumerate([(67, 64), (64, 71), (1, 3)]) for x in range(w) for y in range(h)]
    raster = spark.createDataFrame(rows, "image_id long, x int, y int, c double")
    own = {(i, x, y): c for i, x, y, c in rows}
    back = {(r["image_id"], r["x"], r["y"]): r["c"] for r in wavelets.reconstruct(wavelets.decompose(raster)).collect()}
    found = {r["image_id"]: r for r in wavelets.round_trip(raster).collect()}
    for i, w, h in ((0, 67, 64), (1, 64, 71), (2, 1, 3)):
        places = [(i, x, y) for y in range(h) for x in range(w)]
        assert found[i]["v"] == [own[p] for p in places]
        assert found[i]["back"] == pytest.approx([back[p] for p in places], abs=1e-9)
