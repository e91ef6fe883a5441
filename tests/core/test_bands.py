"""Gradients of blocks come from bands of lines: few groups, and one run of the kernel."""

import os
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from whorl.operators import pixels, tiles  # noqa: E402
from whorl.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.mark.parametrize("name", ["q17_certainty", "q19_orientation"])
def test_pixels_are_grouped_by_band_and_measured_once(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"ObjectHashAggregate\(keys=\[([^]]*)\]", plan)
    assert keys and all(k.count("#") == 2 for k in keys) and plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("offset", [0, 2])
def test_gradients_of_ragged_images(spark, monkeypatch, offset):
    size, rng = 4, np.random.default_rng(7)
    monkeypatch.setattr(tiles, "PIXELS_AT_ONCE", 50)
    shapes = {1: (9, 14), 2: (3, 3), 3: (13, 8), 4: (4, 30)}
    images = {i: rng.integers(-300, 300, s) for i, s in shapes.items()}
    gone = {(1, 1, 1), (3, 5, 6)}  # one pixel without a row, one without a value
    rows = [(i, x, y, None if (i, y, x) == (3, 5, 6) else int(v)) for i, m in images.items() for (y, x), v in np.ndenumerate(m) if (i, y, x) != (1, 1, 1)]
    rows += [(9, x, y, None) for x in range(8) for y in range(8)]
    want = {}
    for i, m in images.items():
        for by in range((m.shape[0] - offset) // size):
            for bx in range((m.shape[1] - offset) // size):
                top, left = offset + by * size, offset + bx * size
                if not any(k == i and top <= y < top + size and left <= x < left + size for k, y, x in gone):
                    gy, gx = np.gradient(m[top : top + size, left : left + size].astype(float))
                    want[i, bx, by] = ((gx * gx).mean(), (gy * gy).mean(), (gx * gy).mean())
    found = pixels.block_gradients(spark.createDataFrame(rows, "image_id long, x int, y int, v int").repartition(5), size, offset)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
