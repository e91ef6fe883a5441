"""The region gathers each image where its pixels lie: one shuffle of keys, none of pixels."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from whorl.operators import pixels, regions, tiles  # noqa: E402
from whorl.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def test_runs_shuffle_keys_alone(spark):
    plan = registry.QUERIES["q15_runs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1


def test_thresholds_of_counts_are_those_of_pixels(spark):
    made = spark.range(3 * 500).selectExpr("id % 3 as image_id", "cast(case when id % 3 = 2 then 7 else id * id * 31 % (97 + 60 * (id % 3)) end as int) as v")
    counts = made.groupBy("image_id").agg(pixels.F.collect_list("v").alias("vs")).selectExpr("image_id", "transform(sequence(0, 255), k -> size(filter(vs, v -> v = k))) as counts")
    found = {r[0]: r[1] for r in counts.select("image_id", pixels.otsu_of(pixels.F.col("counts"))).collect()}
    assert found == {2: None} | {r[0]: r[1] for r in pixels.otsu(made).collect()} and len(found) == 3


def test_images_of_other_sizes_share_a_batch(spark, monkeypatch):
    monkeypatch.setattr(tiles, "PIXELS_AT_ONCE", 5000)
    made = spark.range(4).selectExpr("id as image_id", "explode(sequence(0, 39 + cast(id % 2 as int))) as x").selectExpr("*", "explode(sequence(0, 49 + cast(image_id % 3 as int))) as y")
    made = made.selectExpr("*", "case when pow(x - 18, 2) + pow(y - 22, 2) < 150 + 20 * image_id then 10 else 240 end as v")
    each = lambda df: sorted(map(tuple, regions.region(df).collect()))
    assert each(made.coalesce(1)) == sorted(r for i in range(4) for r in each(made.where(f"image_id = {i}"))) != []
