"""Parts of records that every order needs are computed once and without patterns, with the same results."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))

from whorl.functions import nist  # noqa: E402
from whorl.operators import transactions  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def test_tags_counts_and_bytes_at_their_edges(spark):
    F = nist.F
    tags = spark.createDataFrame([(1, 2), (10, 999), (1, 1000), (1, -1), (None, 3), (2, None), (None, None)], "a int, b int")
    assert all(r[0] == r[1] for r in tags.select(nist.tag(F.col("a"), F.col("b")), F.format_string("%d.%03d", "a", "b")).collect())
    values = ["", "a", nist.RS, nist.US, f"a{nist.US}b{nist.RS}{nist.RS}c{nist.US}", "\xe9€\U0001f600", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", nist.item_count(F.col("v")), nist.subfield_count(F.col("v")), nist.latin1(F.col("v")))
    for v, items, subs, data in rows.collect():
        plain = None if v is None else [s.split(nist.US) for s in v.split(nist.RS)]
        assert (items, subs) == ((None, None) if v is None else (sum(map(len, plain)), len(plain)))
        assert data == (None if v is None else v.encode("latin-1", "replace"))


def test_the_size_of_a_record_is_added_up_once(spark):
    field = nist.F.struct(nist.F.lit(1).alias("record_type"), nist.F.lit(2).alias("field_number"), nist.F.col("v").alias("value"))
    made = spark.createDataFrame([("x",)], "v string").select(transactions.encode_record(nist.F.array(field)))
    assert made._jdf.queryExecution().analyzed().toString().count("aggregate(") <= 2


def test_null_and_empty_files_among_others(spark):
    files = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"1.001:8\x1cx")), (4, None)], "path long, content binary").coalesce(1)
    found = transactions.decode_files(files).orderBy("path", "record_index").select("path", "record_index", "size", "error").collect()
    assert [tuple(r) for r in found] == [(1, None, None, 1000), (2, None, None, None), (3, 0, 8, None), (3, 1, 1, 1012), (4, None, None, 1000)]
