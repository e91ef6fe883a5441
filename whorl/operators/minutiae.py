"""Minutiae as rows (image_id, x, y, angle, confidence, type): ranking, units, counts and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tiles import small

#: Half sides of the window around the centre of mass and of a minutia's neighbourhood.
CENTRE, NEAR = 100, 16


def top_minutiae(minutiae: DataFrame, k: int = 255) -> DataFrame:
    """The ``k`` best of every image, by confidence, then from the top left, then by angle."""
    order = Window.partitionBy("image_id").orderBy(F.desc("confidence"), "y", "x", "angle")
    return minutiae.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _quotient(a: Column, b: Column | int) -> Column:
    """Division of integers that cuts towards zero."""
    q = a / b
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q)).cast("long")


def final_minutiae(minutiae: DataFrame, ppi: int = 500, x_offset: int = 0, y_offset: int = 0) -> DataFrame:
    """Minutiae in the units of the input image.

    Places go to 635 / ppi, then to 197 / 167 (rounded); angles turn the other
    way from the top; quality is half the confidence, at most 100; types other
    than 1 and 2 become 0.
    """
    place = lambda c, off: F.floor((F.abs(x := (_quotient(F.col(c).cast("long") * 635, ppi) + off * 635 // ppi) * 197) + 83) / 167).cast("long") * F.when(x < 0, -1).otherwise(1)
    return minutiae.select(
        "image_id", place("x", x_offset).cast("int").alias("x"), place("y", y_offset).cast("int").alias("y"),
        F.pmod(64 - F.col("angle"), F.lit(256)).cast("int").alias("angle"),
        F.least(F.floor((F.col("confidence") + 1) / 2), F.lit(100)).cast("int").alias("quality"),
        F.when(F.col("type").isin(1, 2), F.col("type")).otherwise(0).cast("int").alias("type"),
    )


def minutia_counts(minutiae: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, ``n`` and ``n_centre`` (within 100 pixels of the whole-numbered centre of mass) of every image.

    ``images``: image_id, width, height; those without minutiae have zeros.
    """
    centre = minutiae.groupBy("image_id").agg(F.floor(F.avg("x")).alias("cx"), F.floor(F.avg("y")).alias("cy"))
    side = lambda c, mid, size: F.col(c).between(F.greatest(F.lit(0), F.col(mid) - CENTRE), F.least(F.col(size) - 1, F.col(mid) + CENTRE))
    placed = images.select("image_id", "width", "height").join(minutiae.select("image_id", "x", "y"), "image_id", "left").join(centre, "image_id", "left")
    return placed.groupBy("image_id").agg(F.count("x").alias("n"), F.count_if(side("x", "cx", "width") & side("y", "cy", "height")).alias("n_centre"))


def mean_quality(minutiae: DataFrame, pixels: DataFrame) -> DataFrame:
    """image_id and ``share`` of minutiae with 0 < (image mean - own mean) / sd <= 0.5, over a 32 x 32 neighbourhood.

    Minutiae at one place share a neighbourhood. Its sum is made of line sums: a
    pixel adds to the columns whose neighbourhoods hold it and their sums to the
    rows, so the work follows the pixels of the images with minutiae.
    """
    ids = minutiae.select("image_id").distinct()
    pixels = pixels.join(small(ids), "image_id", "left_semi")
    stats = pixels.groupBy("image_id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    low = lambda c: F.greatest(F.lit(0), F.col(c) - NEAR)
    asked = minutiae.select("image_id", low("x").alias("x0"), low("y").alias("y0")).groupBy("image_id", "x0", "y0").agg(F.count("*").alias("times"))
    begins = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - 2 * NEAR + 1), F.col(c)))
    across = pixels.where("x >= 0 and y >= 0").select("image_id", "y", "v", begins("x").alias("x0"))
    sums = across.groupBy("image_id", "x0", "y").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    near = sums.select("image_id", "x0", "s", "n", begins("y").alias("y0")).groupBy("image_id", "x0", "y0").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    each = asked.join(near.hint("merge"), ["image_id", "x0", "y0"]).join(small(stats), "image_id")
    z = (F.col("mean") - F.try_divide("s", "n")) / F.col("sd")
    return each.groupBy("image_id").agg((F.sum(F.when((z > 0) & (z <= 0.5), F.col("times")).otherwise(0)) / F.sum("times")).alias("share"))
