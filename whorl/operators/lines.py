"""Rasters as lines: one row (image_id, line, v) with the array of a row's or column's values.

Separable filters run on the lines where they lie; turning lines into the ones
across them is one shuffle of the pixels. No task holds more than its lines.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(pixels: DataFrame, along: str = "x", value: str = "v") -> DataFrame:
    """Rows (``along`` x) or columns (y) of full rasters; ``line`` is the other coordinate."""
    other = "y" if along == "x" else "x"
    each = F.sort_array(F.collect_list(F.struct(F.col(along).alias("at"), F.col(value).cast("double").alias("v"))))
    return pixels.groupBy("image_id", F.col(other).cast("int").alias("line")).agg(each.v.alias("v"))


def turned(rows: DataFrame) -> DataFrame:
    """The lines across: place i of line j becomes place j of line i."""
    each = rows.select("image_id", F.col("line").alias("at"), F.posexplode("v").alias("line", "v"))
    return each.groupBy("image_id", "line").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).v.alias("v"))


def long_form(rows: DataFrame, along: str = "x", value: str = "v") -> DataFrame:
    """image_id, x, y and the value of each pixel of lines."""
    other = "y" if along == "x" else "x"
    return rows.select("image_id", F.col("line").alias(other), F.posexplode("v").alias(along, value)).select("image_id", "x", "y", value)


def filtered(kernel: Callable[[np.ndarray], np.ndarray], v: Column | str = "v") -> Column:
    """A line filter: ``kernel`` takes a matrix of lines of one length and returns as many lines."""

    @F.pandas_udf("array<double>")
    def run(values):
        import pandas as pd

        out, of = [None] * len(values), {}
        for i, row in enumerate(values):
            of.setdefault(len(row), []).append(i)
        for n, places in of.items():
            made = kernel(np.stack([values.iloc[i] for i in places]).astype(float)) if n else np.empty((len(places), 0))
            for i, row in zip(places, made, strict=True):
                out[i] = row
        return pd.Series(out)

    return run(v)


def mirrored(index: np.ndarray, n: int) -> np.ndarray:
    """Places beyond the ends reflected without repeating the end; as often as it takes."""
    if n == 1:
        return np.zeros_like(index)
    index = np.mod(index, 2 * n - 2)
    return np.where(index < n, index, 2 * n - 2 - index)
