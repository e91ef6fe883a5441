"""Features of gray rasters in long form: one row (image_id, x, y, v) per pixel.

Everything is grouping, windows and joins on (image, block), so one image may
be spread over tasks and no task holds more than the rows of a block or line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nist import bound
from .tiles import bands, gradients, small, squares

BLOCK = 32
#: Mean above which a row or column is blank; largest size after the crop.
BLANK, LARGEST = 250, (800, 1000)


def from_bytes(images: DataFrame, id_col: str = "image_id", data_col: str = "pixels") -> DataFrame:
    """Pixels of (id, width, height, bytes) rows; images whose byte count is not width * height are left out."""
    fits = F.octet_length(data_col) == F.col("width") * F.col("height")
    each = images.where(fits & (F.col("width") > 0)).select(F.col(id_col).alias("image_id"), "width", F.posexplode(F.split(F.hex(data_col), "(?<=\\G..)(?=.)")).alias("i", "h"))
    return each.select("image_id", (F.col("i") % F.col("width")).cast("int").alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), F.conv("h", 16, 10).cast("int").alias("v"))


def crop_bounds(pixels: DataFrame) -> DataFrame:
    """image_id, left, top, right, bottom of what is not near white, and ``errors``.

    Errors: 1006 all rows blank, 1007 all columns blank, 1008 and 1009 wider
    or higher than a fingerprint may be.
    """
    axes = F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("at")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("at")))
    lines = pixels.select("image_id", "v", F.inline(axes)).groupBy("image_id", "axis", "at")
    inked = lines.agg(F.avg("v").alias("mean")).withColumn("at", F.when(F.col("mean") <= BLANK, F.col("at")))
    of = lambda axis: F.when(F.col("axis") == axis, F.col("at"))
    found = inked.groupBy("image_id").agg(F.min(of("x")).alias("left"), F.min(of("y")).alias("top"), F.max(of("x")).alias("right"), F.max(of("y")).alias("bottom"))
    size = lambda low, high: F.col(high) - F.col(low) + 1
    blank = F.when(F.col("top").isNull(), F.array(F.lit(1006))).when(F.col("left").isNull(), F.array(F.lit(1007)))
    large = F.array_compact(F.array(F.when(size("left", "right") > LARGEST[0], 1008), F.when(size("top", "bottom") > LARGEST[1], 1009)))
    return found.withColumn("errors", F.coalesce(blank, large))


def crop(pixels: DataFrame) -> DataFrame:
    """Pixels inside the bounds, moved to the origin; images with errors are left out."""
    bounds = crop_bounds(pixels).where("size(errors) = 0").drop("errors")
    return pixels.join(small(bounds), "image_id").where("x between left and right and y between top and bottom").select("image_id", (F.col("x") - F.col("left")).alias("x"), (F.col("y") - F.col("top")).alias("y"), "v")


def pad(pixels: DataFrame, least: int = 196) -> DataFrame:
    """Images smaller than ``least`` filled up with white at the right and the bottom."""
    sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    new = sizes.where((F.col("w") < least) | (F.col("h") < least)).withColumn("y", F.explode(F.sequence(F.lit(0), F.greatest("h", F.lit(least)) - 1)))
    new = new.withColumn("x", F.explode(F.sequence(F.when(F.col("y") < F.col("h"), F.least("w", F.greatest("w", F.lit(least)) - 1)).otherwise(0), F.greatest("w", F.lit(least)) - 1)))
    return pixels.select("image_id", "x", "y", "v").union(new.where("x >= w or y >= h").select("image_id", "x", "y", F.lit(255)))


def _block(axis: str, size: int) -> Column:
    return F.floor(F.col(axis) / size).cast("int")


def mu(pixels: DataFrame, block: int = BLOCK) -> DataFrame:
    """image_id, ``mean``, ``mmb`` (mean of block means, edge blocks count like others) and ``sigma`` (population)."""
    sums = pixels.groupBy("image_id", _block("x", block).alias("bx"), _block("y", block).alias("by")).agg(F.sum("v").alias("s"), F.sum(F.col("v").cast("long") * F.col("v")).alias("q"), F.count("*").alias("n"))
    mean = F.sum("s") / F.sum("n")
    return sums.groupBy("image_id").agg(mean.alias("mean"), F.avg(F.col("s") / F.col("n")).alias("mmb"), F.sqrt(F.sum("q") / F.sum("n") - mean * mean).alias("sigma"))


def normalize(pixels: DataFrame) -> DataFrame:
    """image_id, x, y, c = (v - mean) / scale; scale is the largest distance from the mean / 128, a flat image becomes zeros."""
    stats = pixels.groupBy("image_id").agg(F.avg("v").alias("shift"), F.min("v").alias("low"), F.max("v").alias("high"))
    stats = stats.select("image_id", "shift", (F.greatest(F.col("shift") - F.col("low"), F.col("high") - F.col("shift")) / 128).alias("scale"))
    return pixels.join(small(stats), "image_id").select("image_id", "x", "y", F.when(F.col("scale") == 0, 0.0).otherwise((F.col("v") - F.col("shift")) / F.col("scale")).alias("c"))


def segmentation(pixels: DataFrame, block: int = BLOCK, threshold: float = 0.1) -> DataFrame:
    """image_id, bx, by, ``sd`` of the z-scores of a block and whether it is foreground (sd above the threshold)."""
    blocks = pixels.groupBy("image_id", _block("x", block).alias("bx"), _block("y", block).alias("by")).agg(F.stddev_pop("v").alias("own"))
    whole = pixels.groupBy("image_id").agg(F.stddev_pop("v").alias("all"))
    sd = F.when(F.col("all") > 0, F.col("own") / F.col("all")).otherwise(0.0)
    return blocks.join(small(whole), "image_id").select("image_id", "bx", "by", sd.alias("sd"), (sd > threshold).alias("foreground"))


def block_gradients(pixels: DataFrame, size: int = BLOCK, offset: int = 0) -> DataFrame:
    """image_id, bx, by and the means ``a``, ``b``, ``c`` of gx², gy² and gx·gy of every full block.

    Gradients are central differences, one-sided at the borders of a block.
    """

    @F.arrow_udf("array<struct<bx:int,a:double,b:double,c:double>>")
    def means(values: pa.Array) -> pa.Array:
        of, found = [np.empty(0, int)], [np.empty((4, 0))]
        for band, bx, v in squares(values, size):
            gx, gy = gradients(v, np.ones(v.shape, bool))
            of.append(band)
            found.append(np.stack([bx, *((g * h).sum((1, 2)) / size**2 for g, h in ((gx, gx), (gy, gy), (gx, gy)))]))
        bx, *sums = np.concatenate(found, 1)
        each = pa.StructArray.from_arrays([pa.array(bx.astype(np.int32)), *map(pa.array, sums)], ["bx", "a", "b", "c"])
        return pa.ListArray.from_arrays(np.searchsorted(np.concatenate(of), np.arange(len(values) + 1)).astype(np.int32), each)

    found = bands(pixels, size, offset).select("image_id", "by", means("listed").alias("means"))
    return found.select("image_id", "by", F.inline("means")).select("image_id", "bx", "by", "a", "b", "c")


def orientation_certainty(pixels: DataFrame, size: int = BLOCK) -> DataFrame:
    """image_id, bx, by, ``ocl`` = 1 - smaller / larger eigenvalue of the gradient covariance; flat blocks are left out."""
    root = F.sqrt((F.col("a") - F.col("b")) ** 2 + 4 * F.col("c") ** 2)
    high, low = (F.col("a") + F.col("b") + root) / 2, (F.col("a") + F.col("b") - root) / 2
    return block_gradients(pixels, size).where(high > 0).select("image_id", "bx", "by", (1 - low / high).alias("ocl"))


def ridge_orientation(pixels: DataFrame, size: int = BLOCK, offset: int = 2) -> DataFrame:
    """image_id, bx, by, ``theta`` of the full blocks of a grid that leaves ``offset`` pixels at each side."""
    ends = pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    inside = block_gradients(pixels, size, offset).join(small(ends), "image_id").where(((F.col("bx") + 1) * size + 2 * offset <= F.col("mx") + 1) & ((F.col("by") + 1) * size + 2 * offset <= F.col("my") + 1))
    delta = F.col("a") - F.col("b")
    return inside.select("image_id", "bx", "by", (F.atan2(F.col("c"), delta) / 2).alias("theta"))


def orientation_flow(blocks: DataFrame) -> DataFrame:
    """image_id, bx, by, ``flow``: mean angle to the eight neighbours; places outside the grid count as angle 0.

    ``blocks``: image_id, bx, by, theta.
    """
    # Every block is dealt to the nine places that ask for it, so neighbours meet in a grouping.
    places = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    moves = [F.struct(F.lit(i).alias("move"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(places)]
    dealt = blocks.select("image_id", "bx", "by", "theta", F.inline(F.array(*moves))).select("image_id", (F.col("bx") - F.col("dx")).alias("bx"), (F.col("by") - F.col("dy")).alias("by"), "move", "theta")
    own = places.index((0, 0))
    both = dealt.groupBy("image_id", "bx", "by").agg(F.count_if(F.col("move") == own).alias("n"), *(F.max(F.when(F.col("move") == i, F.col("theta"))).alias(f"theta{i}") for i in range(len(places))))
    apart = [F.abs(F.col(f"theta{own}") - F.coalesce(f"theta{i}", F.lit(0.0))) for i in range(len(places)) if i != own]
    return both.where("n > 0").select("image_id", "bx", "by", (sum((F.least(a, 2 * F.pi() - a) for a in apart), F.lit(0.0)) / 8).alias("flow"))


def flow_measures(flow: DataFrame, foreground: DataFrame, least_degrees: float = 4.0) -> DataFrame:
    """image_id, bx, by, ``value``: flows over ``least_degrees`` rescaled to 90 degrees, where all of the 3 x 3 blocks are foreground.

    ``foreground``: image_id, bx, by, foreground on the grid of the flow.
    """
    moves = [F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    lit = foreground.where("foreground").select("image_id", F.inline(F.array(*moves)), "bx", "by").select("image_id", (F.col("bx") + F.col("dx")).alias("bx"), (F.col("by") + F.col("dy")).alias("by")).groupBy("image_id", "bx", "by").agg(F.count("*").alias("n")).where("n = 9")
    least = F.radians(F.lit(least_degrees))
    # Both meet in a grouping: a join would shuffle them to as many tasks as the session has, whatever their number.
    both = flow.select("image_id", "bx", "by", "flow", F.lit(0).cast("long").alias("n")).union(lit.select("image_id", "bx", "by", F.lit(None).cast("double"), "n"))
    met = both.groupBy("image_id", "bx", "by").agg(F.max("flow").alias("flow"), F.max("n").alias("n")).where("n = 9")
    return met.where(F.col("flow") > least).select("image_id", "bx", "by", ((F.col("flow") - least) / (F.pi() / 2 - least)).alias("value"))


def ridge_valleys(pixels: DataFrame) -> DataFrame:
    """image_id, x, ``mean`` of the column, ``trend`` (least squares over 1-based columns, rounded to ten places) and ``ridge`` (mean below trend)."""
    # Sums stay whole numbers up to the one division, so the rounding does not depend on their order.
    columns = pixels.groupBy("image_id", "x").agg(F.sum("v").alias("s"), F.count("*").alias("h"))
    return with_trend(columns, ["image_id"]).select("image_id", "x", "mean", "trend", "ridge")


def with_trend(columns: DataFrame, key: list[str]) -> DataFrame:
    """Columns (``key``, x, sum ``s`` and height ``h``) with ``mean``, ``trend`` and ``ridge``; see ``ridge_valleys``."""
    n, x = F.count("*"), F.col("x").cast("long") + 1
    line = columns.groupBy(*key).agg(F.first("h").alias("lh"), n.alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum("s").alias("sy"), F.sum(x * F.col("s")).alias("sxy"))
    under = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(under == 0, 0.0).otherwise((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (under * F.col("lh")))
    line = line.withColumn("slope", slope).select(*key, F.round("slope", 10).alias("slope"), F.round((F.col("sy") / F.col("lh") - F.col("slope") * F.col("sx")) / F.col("n"), 10).alias("intercept"))
    mean, trend = F.col("s") / F.col("h"), (F.col("x") + 1) * F.col("slope") + F.col("intercept")
    return columns.join(small(line), key).withColumns({"mean": mean, "trend": trend, "ridge": mean < trend})


def unpack_bits(images: DataFrame, id_col: str = "image_id", data_col: str = "bits") -> DataFrame:
    """Pixels of one-bit images: rows of ceil(width / 8) bytes, highest bit first, 1 is 255."""
    stride = F.ceil(F.col("width") / 8).cast("int")
    each = images.select(F.col(id_col).alias("image_id"), "width", data_col, stride.alias("stride"), F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    byte = F.conv(F.hex(F.expr(f"substring({data_col}, y * stride + x div 8 + 1, 1)")), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), 7 - F.col("x") % 8)) % 2
    return each.select("image_id", "x", "y", (bit * 255).cast("int").alias("v"))


def otsu(pixels: DataFrame) -> DataFrame:
    """image_id and the gray value ``threshold`` that separates the two classes best, the lowest of equals."""
    hist = pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    upto, every = Window.partitionBy("image_id").orderBy("v"), Window.partitionBy("image_id")
    w0, s0 = F.sum("n").over(upto).cast("double"), F.sum(F.col("n") * F.col("v")).over(upto).cast("double")
    n, s = F.sum("n").over(every).cast("double"), F.sum(F.col("n") * F.col("v")).over(every).cast("double")
    cuts = hist.select("image_id", "v", w0.alias("w0"), s0.alias("s0"), n.alias("n"), s.alias("s")).where("w0 < n")
    between = F.round(F.col("w0") * (F.col("n") - F.col("w0")) * (F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("n") - F.col("w0"))) ** 2, 6)
    return cuts.groupBy("image_id").agg(F.max(F.struct(between.alias("b"), (-F.col("v")).alias("v"))).alias("best")).select("image_id", (-F.col("best.v")).cast("int").alias("threshold"))


def otsu_of(counts: Column) -> Column:
    """The threshold of ``otsu`` from the array of the counts of the values 0, 1, ... of an image; null for a flat one."""
    zero, number = F.lit(0.0), lambda c: c.cast("double")
    there = F.filter(F.transform(counts, lambda n, v: F.struct(v.alias("v"), number(n).alias("n"))), lambda p: p.n > 0)
    start = F.struct(zero.alias("w0"), zero.alias("s0"), F.lit(None).cast("double").alias("b"), F.lit(None).cast("int").alias("v"))

    def best(of: Column) -> Column:
        def step(a: Column, p: Column) -> Column:
            w0, s0 = a.w0 + p.n, a.s0 + p.n * p.v
            between = F.when(w0 < of.n, F.round(w0 * (of.n - w0) * (s0 / w0 - (of.s - s0) / (of.n - w0)) ** 2, 6))
            better = lambda b: b.isNotNull() & (a.b.isNull() | (b > a.b))
            chosen = lambda b: F.struct(w0.alias("w0"), s0.alias("s0"), F.when(better(b), b).otherwise(a.b).alias("b"), F.when(better(b), p.v).otherwise(a.v).alias("v"))
            return bound(between, chosen)

        return F.aggregate(of.there, start, step, lambda a: a.v)

    whole = lambda t: F.struct(t.alias("there"), F.aggregate(t, zero, lambda n, p: n + p.n).alias("n"), F.aggregate(t, zero, lambda s, p: s + p.n * p.v).alias("s"))
    return bound(there, lambda t: bound(whole(t), best))
