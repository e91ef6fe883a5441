"""Turned blocks and their measures against plain loops over one block at a time."""

import math
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))

from whorl.operators import slanted  # noqa: E402

KEY = ["image_id", "bx", "by"]


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture(scope="module")
def image(spark):
    rng = np.random.default_rng(6)
    y, x = np.mgrid[0:110, 0:90]
    v = np.clip(128 + 100 * np.sin((x * 0.8 + y * 0.3)) + rng.normal(0, 20, x.shape), 0, 255).astype(int)
    rows = [(1, int(a), int(b), int(v[b, a])) for b in range(110) for a in range(90)]
    return v, spark.createDataFrame(rows, "image_id long, x int, y int, v int").cache()


def plain_turn(v, left, top, width, height, border, angle):
    """Middle of the 36 x 36 square at (left, top), turned by a matrix about its centre."""
    side = 36 + 2 * border
    a, b, c = math.cos(angle), math.sin(angle), side / 2
    forward = np.array([[a, b, (1 - a) * c - b * c], [-b, a, b * c + (1 - a) * c], [0, 0, 1]])
    back = np.linalg.inv(forward)
    x0, y0 = 18 - width // 2, 18 - height // 2
    out = np.zeros((height, width), int)
    for y in range(height):
        for x in range(width):
            place = []
            for row in back[:2]:
                start = round((row[1] * (y + y0) + row[2]) * 1024) + 512
                place.append((start + round(row[0] * (x + x0) * 1024)) >> 10)
            if all(0 <= p < side for p in place):
                px, py = left - border + place[0], top - border + place[1]
                out[y, x] = v[py, px] if 0 <= py < v.shape[0] and 0 <= px < v.shape[1] else 0
    return out


def plain_pattern(block):
    means = block.mean(0)
    x = np.arange(1, len(means) + 1)
    slope, intercept = np.polyfit(x, means, 1)
    trend = np.round(slope, 10) * x + np.round(intercept, 10)
    return means < trend, trend


def plain_ratios(ridge):
    at = [i - 1 for i in range(1, len(ridge) - 1) if ridge[i] != ridge[i - 1]]
    widths = [b - a for a, b in zip(at[1:], at[2:], strict=False)][::-1]
    out, first = [], int(ridge[at[0] + 1]) if at else 0
    for k, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
        out.append(b / a if k >= first and (k - first) % 2 == 0 else a / b)
    return out


def plain_clarity(block):
    ridge, trend = plain_pattern(block)
    at = [i - 1 for i in range(1, len(ridge)) if ridge[i] != ridge[i - 1]]
    if not at:
        return 0.0
    widths = np.diff([0, *at])
    kinds = [ridge[0] == (k % 2 == 0) for k in range(len(widths))]
    mean = lambda kind: np.mean([w for w, k in zip(widths, kinds, strict=True) if k == kind] or [0]) / 20
    if not (0.15 <= mean(True) <= 0.5 and 0.1 <= mean(False) <= 0.5):
        return 0.0
    bad = (block >= trend)[:, ridge].mean(), (block < trend)[:, ~ridge].mean()
    return 1 - sum(bad) / 2


def plain_frequency(block):
    a = np.round(np.abs(np.fft.fft(block.mean(1)))[1:], 9)
    k = int(np.argmax(a))
    return 1.0 if k in (0, len(a) - 1) else (a[k] + 0.3 * (a[k - 1] + a[k + 1])) / a[: len(a) // 2].sum()


def test_blocks_and_measures_equal_plain_loops(spark, image):
    v, pixels = image
    angles = [0.0, 0.3, -0.7, 1.2, math.pi / 2, -1.5707, 2.9, 0.785]
    blocks = [(1, k % 2, k // 2 % 3, angles[k]) for k in range(6)]
    table = spark.createDataFrame(blocks, "image_id long, bx int, by int, theta double")
    for width, height, border, turn in ((32, 16, 0, 0.0), (32, 16, 2, 0.0), (16, 32, 2, math.pi / 2)):
        turned = slanted.turned_blocks(pixels, table, width, height, border, turn).cache()
        want = {(bx, by): plain_turn(v, bx * 32, by * 32, width, height, border, theta + turn) for _, bx, by, theta in blocks}
        got = {k: np.zeros((height, width), int) for k in want}
        for r in turned.collect():
            got[r["bx"], r["by"]][r["y"], r["x"]] = r["v"]
        assert all((got[k] == want[k]).all() for k in want)
        if width == 32:
            ratios = {}
            for r in slanted.uniformity_ratios(turned).orderBy("turn").collect():
                ratios.setdefault((r["bx"], r["by"]), []).append(r["value"])
            assert {k: pytest.approx(plain_ratios(plain_pattern(b)[0])) for k, b in want.items() if plain_ratios(plain_pattern(b)[0])} == ratios
            clarity = {(r["bx"], r["by"]): r["value"] for r in slanted.local_clarity(turned).collect()}
            assert {k: pytest.approx(plain_clarity(b)) for k, b in want.items()} == clarity
            assert max(clarity.values()) > 0
        else:
            found = {(r["bx"], r["by"]): r["value"] for r in slanted.frequencies(turned).collect()}
            assert {k: pytest.approx(plain_frequency(b)) for k, b in want.items()} == found


def test_flat_blocks(spark):
    flat = spark.range(64 * 64).selectExpr("1L as image_id", "cast(id % 64 as int) as x", "cast(id div 64 as int) as y", "99 as v")
    blocks = spark.createDataFrame([(1, 0, 0, 0.4)], "image_id long, bx int, by int, theta double")
    turned = slanted.turned_blocks(flat, blocks, border=0).withColumn("v", slanted.F.lit(99))
    assert slanted.local_clarity(turned).first()["value"] == 0 and slanted.uniformity_ratios(turned).count() == 0
    assert slanted.valid_blocks(flat).count() == 0
    values = spark.createDataFrame([(1, 0.3)] * 9 + [(2, 0.3)] * 10, "image_id int, value double")
    rows = {r["image_id"]: r for r in slanted.block_features(values, slanted.FREQUENCY_BOUNDS, "FDA_Bin10_", slanted.FEWEST).collect()}
    assert rows[1]["error"] and rows[1]["FDA_Bin10_Mean"] is None and rows[2]["error"] is None and rows[2]["FDA_Bin10_1"] == 10
