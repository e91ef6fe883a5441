"""Record framing by stated lengths and the window rule of subband variances."""

import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(__file__)))
sys.path.insert(0, ROOT)

from whorl.operators import transactions  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def fielded(kind, *fields):
    body = b"".join(b"\x1d%d.%03d:%b" % (kind, n, v) for n, v in fields) + b"\x1c"
    head = b"%d.001:" % kind
    size = next(n for n in range(1000) if n == len(head) + len(str(n)) + len(body))
    return head + b"%d" % size + body


FIRST = fielded(1, (2, b"0500"), (3, b"1\x1f3\x1e10\x1f01\x1e4\x1f02\x1e2\x1f03"))
IMAGE = fielded(10, (2, b"01"), (999, b"\xff\x1c\x00\x1d\x1c2.001:9\x1c"))
BINARY = (30).to_bytes(4, "big") + b"\x02\x1c\x1d" + b"\xaa" * 23
LAST = fielded(2, (2, b"03"))


def test_records_are_framed_by_their_lengths(spark):
    files = [("a", FIRST + IMAGE + BINARY + LAST), ("cut", FIRST + IMAGE[:-1]), ("more", FIRST + IMAGE + BINARY + LAST + BINARY), ("none", b""), ("null", None), ("text", b"no record\x1c"), ("short", FIRST + b"\x00\x00")]
    got = transactions.decode_files(spark.createDataFrame(files, "path string, content binary")).orderBy("path", "record_index").collect()
    a = [r for r in got if r["path"] == "a"]
    sizes = [len(x) for x in (FIRST, IMAGE, BINARY, LAST)]
    assert [(r["type"], r["size"], r["byte_offset"], r["error"]) for r in a] == [(k, n, sum(sizes[:i]), None) for i, (k, n) in enumerate(zip((1, 10, 4, 2), sizes, strict=True))]
    assert a[1]["pieces"][-1].encode("latin-1") == b"10.999:\xff\x1c\x00\x1d\x1c2.001:9\x1c"
    assert (bytes(a[2]["data"]), a[2]["pieces"], a[0]["data"]) == (BINARY, [], None)
    errors = {(r["path"], r["record_index"]): r["error"] for r in got if r["error"] is not None}
    assert errors == {("cut", 1): 1002, ("more", 4): 1012, ("text", 0): 1000, ("null", None): 1000, ("short", 1): 1007}
    records = transactions.decode_files(spark.createDataFrame(files[:1], "path string, content binary"))
    assert transactions.content_mismatches(transactions.fields_of(records), records).count() == 0


def test_subband_variances_take_both_branches(spark):
    from whorl.operators import subbands

    r = np.random.default_rng(1)
    images = {1: r.normal(0, 200, (40, 40)), 2: r.normal(0, 9, (40, 40))}
    images[2][0, 0] = 5000  # outside every cropped window
    nodes = [(k, 20 * (k % 2), 13 * (k // 2), 20, 13) for k in range(6)]
    pixels = [(i, x, y, float(v[y, x])) for i, v in images.items() for y in range(40) for x in range(40)]
    got = subbands.subband_variances(spark.createDataFrame(pixels, "image_id int, x int, y int, c double"), spark.createDataFrame([(i, *n) for i in images for n in nodes], "image_id int, subband int, x int, y int, width int, height int")).collect()
    want = {}
    for i, v in images.items():
        whole = [v[y : y + h, x : x + w] for _, x, y, w, h in nodes]
        inner = [v[y + 9 * h // 32 :, x + w // 8 :][: 7 * h // 16, : 3 * w // 4] for _, x, y, w, h in nodes]
        low = sum(m.var(ddof=1) for m in inner[:4]) < 20000
        want |= {(i, k): (not low, m.var(ddof=1)) for k, m in enumerate(whole if low else inner)}
    assert {c for c, _ in want.values()} == {True, False} and len(got) == len(want)
    for row in got:
        cropped, variance = want[row["image_id"], row["subband"]]
        assert row["cropped"] == cropped and row["variance"] == pytest.approx(variance)
