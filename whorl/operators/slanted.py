"""Measures of slanted blocks: blocks turned by their ridge orientation, and what their lines tell.

A block is 32 pixels square and lies inside the foreground. Around it 36 pixels are
turned in fixed point; the middle of the result is 32 by 16 pixels, along the
ridges for clarity and uniformity and across them for the frequencies.
Everything is joins, groupings and windows on (image, block).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pixels import BLOCK, ridge_orientation, segmentation, with_trend
from .reports import histogram_features
from .tiles import listed, sheets

# Side of the turned square, its distance from the block, bits of its fixed point, sizes of the middle.
SQUARE, OFFSET, BITS, LONG, SHORT = 36, 2, 10, 32, 16
# Widths of ridges and valleys that count (in pixels), the widest ones at 125 pixels an inch, and the resolution.
RIDGE_WIDTHS, VALLEY_WIDTHS, WIDEST, PPI = (3.0, 10.0), (2.0, 10.0), 5.0, 500
# Bounds of the histograms, share of neighbouring frequencies, fewest blocks for frequencies.
CLARITY_BOUNDS = (0.0, 0.70, 0.74, 0.77, 0.79, 0.81, 0.83, 0.85, 0.87)
UNIFORMITY_BOUNDS = (0.5, 0.667, 0.8, 1.0, 1.25, 1.5, 2.0, 24.0, 30.0)
FREQUENCY_BOUNDS = (0.268, 0.304, 0.33, 0.355, 0.38, 0.407, 0.44, 0.50, 1.0)
NEAR, FEWEST = 0.3, 10
KEY = ("image_id", "bx", "by")


def valid_blocks(pixels: DataFrame) -> DataFrame:
    """image_id, bx, by, theta of the blocks (moved by two pixels) that touch foreground blocks only."""
    found = ridge_orientation(pixels, BLOCK, OFFSET)
    corners = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)))
    touched = found.select(*KEY, F.inline(corners)).select("image_id", (F.col("bx") + F.col("dx")).alias("sx"), (F.col("by") + F.col("dy")).alias("sy"), "bx", "by")
    lit = segmentation(pixels).where("foreground").select("image_id", F.col("bx").alias("sx"), F.col("by").alias("sy"))
    inside = touched.join(lit.hint("merge"), ["image_id", "sx", "sy"]).groupBy(*KEY).agg(F.count("*").alias("n")).where("n = 4")
    return found.join(inside.hint("merge"), list(KEY), "left_semi")


def turned_lines(pixels: DataFrame, blocks: DataFrame, width: int = LONG, height: int = SHORT, border: int = 0, turn: float = 0.0, along: str = "y") -> DataFrame:
    """image_id, bx, by, x, v: the columns of the middle of each block turned by ``theta`` + ``turn``; its rows (y, v) with ``along`` x.

    ``border``: pixels around the square that may be sampled too. Places
    outside it and outside the image are black.
    """
    angle = F.col("theta") + turn
    side, a, b = SQUARE + 2 * border, F.cos(angle), F.sin(angle)
    centre = side / 2.0
    # The forward turn about the centre, inverted.
    e, f = (1 - a) * centre - b * centre, b * centre + (1 - a) * centre
    det = a * a + b * b
    placed = blocks.select(*KEY, (a / det).alias("a"), (b / det).alias("b"), e.alias("e"), f.alias("f"))
    placed = placed.withColumns({"shift_x": -F.col("a") * F.col("e") + F.col("b") * F.col("f"), "shift_y": -F.col("b") * F.col("e") - F.col("a") * F.col("f")})
    left, top = SQUARE // 2 - (width // 2 - 1) - 1, SQUARE // 2 - (height // 2 - 1) - 1
    # A block begins two pixels from the grid and its square two pixels before it; a pixel lies in the squares of up to four blocks.
    squares = listed(pixels, BLOCK, -border, side)
    both = placed.join(squares.hint("merge"), list(KEY), "left").withColumn("listed", F.coalesce("listed", F.array().cast("array<bigint>")))
    x, y, unit = np.arange(width)[None, :] + left, np.arange(height)[:, None] + top, 1 << BITS

    def source(per_x, per_y, shift) -> np.ndarray:
        """Fixed point: line start and step are rounded to even, their sum to the nearest place."""
        per_x, per_y, shift = (c[:, None, None] for c in (per_x, per_y, shift))
        start = np.rint((per_y * y + shift) * unit) + unit / 2
        return np.floor((start + np.rint(per_x * x * unit)) / unit).astype(int)

    @F.arrow_udf("array<array<int>>")
    def middle(values: pa.Array, a: pa.Array, b: pa.Array, shift_x: pa.Array, shift_y: pa.Array) -> pa.Array:
        found, at = [np.empty(0, np.int32)], 0
        turns = [c.to_numpy(zero_copy_only=False) for c in (a, b, shift_x, shift_y)]
        for black, _ in sheets(values, side):
            n = len(black)
            a, b, to_x, to_y = (c[at : at + n] for c in turns)
            sx, sy = source(a, -b, to_x), source(b, a, to_y)
            inside = (sx >= 0) & (sx < side) & (sy >= 0) & (sy < side)
            made = np.where(inside, black[np.arange(n)[:, None, None], np.where(inside, sy, 0), np.where(inside, sx, 0)], 0).astype(np.int32)
            found.append((made if along == "x" else made.transpose(0, 2, 1)).ravel())
            at += n
        lines, length = (height, width) if along == "x" else (width, height)
        each = pa.ListArray.from_arrays(np.arange(at * lines + 1, dtype=np.int32) * length, np.concatenate(found))
        return pa.ListArray.from_arrays(np.arange(at + 1, dtype=np.int32) * lines, each)

    return both.select(*KEY, F.posexplode(middle("listed", "a", "b", "shift_x", "shift_y")).alias("y" if along == "x" else "x", "v"))


def turned_blocks(pixels: DataFrame, blocks: DataFrame, width: int = LONG, height: int = SHORT, border: int = 0, turn: float = 0.0) -> DataFrame:
    """image_id, bx, by, x, y, v: the pixels of ``turned_lines``."""
    rows = turned_lines(pixels, blocks, width, height, border, turn, "x")
    return rows.select(*KEY, "y", F.posexplode("v").alias("x", "v")).select(*KEY, "x", "y", "v")


def _gathered(turned: DataFrame, line: str) -> DataFrame:
    """Turned blocks as lines (KEY, ``line``, list v); pixels are grouped, lines stay."""
    if turned.schema["v"].dataType.typeName() == "array":
        return turned
    return turned.groupBy(*KEY, line).agg(F.collect_list("v").alias("v"))


def _structure(columns: DataFrame) -> DataFrame:
    """image_id, bx, by, x, v, trend, ridge of the columns of turned blocks."""
    summed = columns.select(*KEY, "x", "v", F.aggregate("v", F.lit(0).cast("long"), lambda s, v: s + v).alias("s"), F.size("v").cast("long").alias("h"))
    return with_trend(summed, list(KEY)).select(*KEY, "x", "v", "trend", "ridge")


def _changes(structure: DataFrame) -> DataFrame:
    """image_id, bx, by, ``at`` (the column before a change) and ``ended`` (whether a ridge ends there)."""
    line = Window.partitionBy(*KEY).orderBy("x")
    marked = structure.withColumn("before", F.lag("ridge").over(line))
    return marked.where("before <> ridge").select(*KEY, (F.col("x") - 1).alias("at"), F.col("before").alias("ended"))


def local_clarity(turned: DataFrame) -> DataFrame:
    """image_id, bx, by, ``value``: one minus the mean share of pixels of ridges and valleys on the wrong side of the trend.

    0 for blocks without a change, with a mean width of ridges or valleys
    that is none of a finger, or with one kind only.
    """
    structure = _structure(_gathered(turned, "x"))
    # Means often lie exactly on a bound, and the last digit of a sum depends on its order: widths are added from the first on, however a grouping is split.
    changes = _changes(structure).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("at", "ended"))).alias("changes"))
    width = lambda c, i: c.at - F.coalesce(F.get("changes", i - 1).at, F.lit(0))
    widths = changes.select(*KEY, F.transform("changes", lambda c, i: F.struct(c.ended.alias("ended"), width(c, i).alias("width"))).alias("widths"))
    scale = PPI / 125.0 * WIDEST

    def mean(ended: bool) -> Column:
        chosen = F.filter("widths", lambda w: w.ended if ended else ~w.ended)
        return F.coalesce(F.try_divide(F.aggregate(chosen, F.lit(0.0), lambda s, w: s + w.width / scale), F.size(chosen)), F.lit(0.0))

    means = widths.select(*KEY, mean(True).alias("ridge_width"), mean(False).alias("valley_width"))
    fits = lambda c, widths: F.col(c).between(widths[0] / scale, widths[1] / scale)
    usual = means.where(fits("ridge_width", RIDGE_WIDTHS) & fits("valley_width", VALLEY_WIDTHS)).select(*KEY)
    size, high = F.size("v"), F.size(F.filter("v", lambda v: v >= F.col("trend")))
    of = lambda kind, n: F.coalesce(F.sum(F.when(kind, n)), F.lit(0))
    counts = structure.groupBy(*KEY).agg(of(F.col("ridge"), high).alias("ridge_bad"), of(F.col("ridge"), size).alias("n_ridge"), of(~F.col("ridge"), size - high).alias("valley_bad"), of(~F.col("ridge"), size).alias("n_valley"))
    score = 1 - (F.try_divide("valley_bad", "n_valley") + F.try_divide("ridge_bad", "n_ridge")) / 2
    return counts.join(usual.withColumn("usual", F.lit(True)).hint("merge"), list(KEY), "left").select(*KEY, F.when(F.col("usual") & score.isNotNull(), score).otherwise(0.0).alias("value"))


def uniformity_ratios(turned: DataFrame) -> DataFrame:
    """image_id, bx, by, turn, ``value``: ratios of neighbouring widths of whole ridges and valleys, ridge to valley, from the last width on.

    Widths lie between the first and the last change; a change at the last
    column does not count.
    """
    structure = _structure(_gathered(turned, "x"))
    last = structure.groupBy(*KEY).agg(F.max("x").alias("end"))
    changes = _changes(structure).join(last.hint("merge"), list(KEY)).where("at < end - 1")
    line = Window.partitionBy(*KEY).orderBy("at")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    widths = changes.select(*KEY, "at", (F.col("at") - F.lag("at").over(line)).alias("width"), (~F.first("ended").over(whole)).cast("int").alias("ridge_first"), F.row_number().over(line).alias("n"), F.count("*").over(whole).alias("m"))
    # The part up to the second change is left out, as it is taken from the first change on.
    pairs = widths.withColumn("earlier", F.lag("width").over(line)).where("n >= 4").withColumn("turn", F.col("m") - F.col("n"))
    ratio = F.col("width") / F.col("earlier")
    swap = (F.col("turn") >= F.col("ridge_first")) & ((F.col("turn") - F.col("ridge_first")) % 2 == 0)
    return pairs.select(*KEY, F.col("turn").cast("int"), F.when(swap, 1 / ratio).otherwise(ratio).alias("value"))


def frequencies(turned: DataFrame) -> DataFrame:
    """image_id, bx, by, ``value``: share of the strongest frequency of the row means, with parts of its neighbours, in the lower half.

    1 where the strongest one is the first or the last of the spectrum.
    """
    total = F.aggregate("v", F.lit(0.0), lambda s, v: s + v)
    means = _gathered(turned, "y").groupBy(*KEY).agg(F.collect_list(F.struct("y", (total / F.size("v")).alias("mean"))).alias("means"))

    @F.pandas_udf("array<double>")
    def amplitudes(places, values):
        import pandas as pd

        out, of = [None] * len(places), {}
        for i, place in enumerate(places):
            of.setdefault(int(max(place)) + 1, []).append(i)
        for n, chosen in of.items():
            rows = np.zeros((len(chosen), n))
            for row, i in zip(rows, chosen, strict=True):
                row[places.iloc[i]] = values.iloc[i]
            angle = -2 * np.pi * (np.outer(np.arange(n), np.arange(1, n)) % n) / n
            for i, a in zip(chosen, np.hypot(rows @ np.cos(angle), rows @ np.sin(angle)), strict=True):
                out[i] = a
        return pd.Series(out)

    found = means.select(*KEY, F.size("means").alias("n"), F.posexplode(amplitudes("means.y", "means.mean")).alias("f", "a"))
    spectrum = found.withColumns({"f": F.col("f") + 1, "n": F.max("f").over(Window.partitionBy(*KEY)) + 2})
    # Equal amplitudes are equal whatever their sums' rounding; the first one counts.
    spectrum = spectrum.select(*KEY, "n", "f", F.round("a", 9).alias("a"))
    line = Window.partitionBy(*KEY).orderBy("f")
    near = spectrum.withColumns({"left": F.lag("a").over(line), "right": F.lead("a").over(line)})
    peak = near.groupBy(*KEY, "n").agg(F.max(F.struct("a", (-F.col("f")).alias("f"), "left", "right")).alias("top"), F.sum(F.when(F.col("f") <= F.floor((F.col("n") - 1) / 2), F.col("a"))).alias("total"))
    share = F.try_divide(F.col("top.a") + NEAR * (F.col("top.left") + F.col("top.right")), F.col("total"))
    edge = F.col("top.left").isNull() | F.col("top.right").isNull() | (F.col("n") <= 3)
    return peak.select(*KEY, F.when(edge, 1.0).otherwise(share).alias("value"))


def block_features(values: DataFrame, bounds: tuple[float, ...], prefix: str, fewest: int = 0) -> DataFrame:
    """Histogram features of one row per image, with ``error`` for images with fewer than ``fewest`` values."""
    counted = values.select(F.struct("image_id", F.count("*").over(Window.partitionBy("image_id")).alias("n")).alias("image"), "value")
    found = histogram_features(counted, "value", bounds, prefix, "image")
    short = F.col("image.n") < fewest
    return found.select("image.image_id", F.when(short, "not enough blocks").alias("error"), *(F.when(~short, F.col(c)).alias(c) for c in found.columns if c.startswith(prefix)))
