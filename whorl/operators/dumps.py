"""Byte differences of files that should be equal, by a table function over partitions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codestream import segments

#: Bytes of each side that a difference shows.
SHOWN = 32


@F.udtf(returnType="path string, byte_offset bigint, length bigint, expected binary, actual binary")
class ByteDifferences:
    """Rows (path, side, content) of one path: the ranges in which ``expected`` and ``actual`` differ.

    A longer file differs to its end; a file with one side only, or a null
    content, is compared with no bytes. A partition holds the two contents of its path.
    """

    def __init__(self):
        self.path, self.sides = None, {}

    def eval(self, row) -> None:
        self.path = row["path"]
        self.sides[row["side"]] = bytes(row["content"] or b"")

    def terminate(self) -> Iterator[tuple]:
        import numpy as np

        a, b = (self.sides.get(side, b"") for side in ("expected", "actual"))
        both = min(len(a), len(b))
        differs = np.ones(max(len(a), len(b)) + 2, bool)
        differs[1 : both + 1] = np.frombuffer(a, np.uint8, both) != np.frombuffer(b, np.uint8, both)
        differs[0] = differs[-1] = False
        edges = np.flatnonzero(differs[1:] != differs[:-1])
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            stop = min(end, start + SHOWN)
            yield self.path, start, end - start, a[start:stop], b[start:stop]


def byte_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, byte_offset, length and the first bytes of both sides of every differing range; files: path, content."""
    side = lambda df, name: df.select(F.col("path").cast("string").alias("path"), F.lit(name).alias("side"), "content")
    return ByteDifferences(side(expected, "expected").union(side(actual, "actual")).asTable().partitionBy("path"))


def segment_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Byte differences with the ``segment`` and ``marker`` of the expected file in which they begin, null before the first one."""
    found = byte_differences(expected, actual)
    held = segments(expected).select("path", F.struct("byte_offset", "segment", "marker").alias("s"))
    near = found.join(held, "path").where(F.col("s.byte_offset") <= F.col("byte_offset")).groupBy("path", "byte_offset").agg(F.max("s").alias("s"))
    return found.join(near, ["path", "byte_offset"], "left").select("path", "byte_offset", "length", "expected", "actual", "s.segment", "s.marker")
