"""Flow and foreground meet where their blocks lie: only keys are shuffled."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from whorl.plans import registry  # noqa: E402


def test_flow_shuffles_keys_alone():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    plan = registry.QUERIES["q20_flow"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2
