"""Byte differences of pairs of files, and the segments in which they begin."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))

from whorl.operators import dumps  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def test_ranges_and_segments(spark):
    comment = b"\xff\xa8\x00\x06abcd"
    good = b"\xff\xa0" + comment + b"\xff\xa8\x00\x04xy" + b"\xff\xa2"
    pairs = {"same": (good, good), "text": (good, good.replace(b"bc", b"BC").replace(b"y", b"z")), "short": (good, good[:-3]), "none": (None, b"ab"), "empty": (b"", b""), "long": (bytes(100), b"\x01" * 100)}
    sides = [spark.createDataFrame([(k, v[i]) for k, v in pairs.items()], "path string, content binary") for i in (0, 1)]
    got = sorted((r["path"], r["byte_offset"], r["length"], bytes(r["expected"]), bytes(r["actual"])) for r in dumps.byte_differences(*sides).collect())
    n = len(good)
    assert got == [("long", 0, 100, bytes(32), b"\x01" * 32), ("none", 0, 2, b"", b"ab"), ("short", n - 3, 3, good[-3:], b""), ("text", 7, 2, b"bc", b"BC"), ("text", 15, 1, b"y", b"z")]
    found = {(r["path"], r["byte_offset"]): (r["segment"], r["marker"]) for r in dumps.segment_differences(*sides).collect()}
    assert found["text", 7] == (1, 0xFFA8) and found["text", 15] == (2, 0xFFA8) and found["none", 0] == (0, None)
    assert dumps.byte_differences(*(s.limit(0) for s in sides)).count() == 0
