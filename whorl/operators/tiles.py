"""Pixels gathered for kernels: one row per block or per image instead of one per pixel.

Gathering is a grouping like any other. Where the rows of an image lie together
already (``spread``) it needs no shuffle, and what follows shuffles blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task makes from the keys dealt to it.
PER_TASK = 1 << 21


def spread(df: DataFrame, key: str, each: int) -> DataFrame:
    """``df`` dealt by ``key`` to so many tasks that none makes many more than ``PER_TASK`` rows, where each row becomes ``each``.

    A small file is one task however much is made of it. All rows of a key stay
    together, so groupings by the key and more find them where they are. Never fewer
    tasks than a shuffle has, or a join would shuffle the pixels to have more.
    """
    return df.repartition(tasks(df, each), key)


def tasks(df: DataFrame, each: int) -> int:
    """Number of tasks for rows that cost as much as ``each`` made rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() * each / PER_TASK))


def small(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is held; sizes of made pixels are estimated too low, so a plain join may send them to the driver."""
    return df.hint("shuffle_hash")


def listed(pixels: DataFrame, size: int, origin: int = 0, side: int | None = None) -> DataFrame:
    """image_id, bx, by, ``listed``: the pixels of the squares that begin at ``origin`` + b * ``size`` on both axes.

    ``side``: length of a square where squares overlap. A pixel is place (row by row)
    times 2^32 plus the whole-numbered value, offset by 2^31. Pixels without a value are left out.
    """
    side = side or size
    at = lambda c: F.col(c) - origin
    if side == size:
        each = pixels.select("image_id", "x", "y", "v", *(F.floor(at(c) / size).cast("int").alias(f"b{c}") for c in "xy"))
    else:
        near = lambda c: F.sequence(F.floor((at(c) - side) / size).cast("int") + 1, F.floor(at(c) / size).cast("int"))
        each = pixels.select("image_id", "x", "y", "v", F.explode(near("x")).alias("bx")).withColumn("by", F.explode(near("y")))
    place = (at("y") - F.col("by") * size) * side + at("x") - F.col("bx") * size
    number = place.cast("long") * F.lit(1 << 32) + F.col("v").cast("long") + F.lit(1 << 31)
    # A list takes no nulls; a filter on the value would make it twice.
    return each.groupBy("image_id", "bx", "by").agg(F.collect_list(number).alias("listed")).where("size(listed) > 0")


def bands(pixels: DataFrame, size: int, origin: int = 0) -> DataFrame:
    """image_id, by, ``listed``: the pixels of ``size`` lines from ``origin`` + by * ``size`` on, for ``squares``.

    There are fewer groups than squares, so grouping costs less. A pixel is (x * ``size`` + y)
    from the corner of the band, times 2^32, plus the whole-numbered value, offset by 2^31.
    Pixels before the origin or without a value are left out.
    """
    x, y = F.col("x") - origin, F.col("y") - origin
    number = (x.cast("long") * size + y % size) * F.lit(1 << 32) + F.col("v").cast("long") + F.lit(1 << 31)
    each = pixels.where((F.col("x") >= origin) & (F.col("y") >= origin)).select("image_id", F.floor(y / size).cast("int").alias("by"), number.alias("number"))
    return each.groupBy("image_id", "by").agg(F.collect_list("number").alias("listed"))


def squares(values: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of the bands, bx, squares y x) of the full squares in a stretch of ``bands`` lists."""
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for part in chunks(lengths):
        flat = values.slice(part.start, part.stop - part.start).flatten().to_numpy()
        place = flat >> 32
        bx, cell = np.divmod(place, size * size)
        each = int(bx.max(initial=-1)) + 1
        group = np.repeat(np.arange(part.stop - part.start), lengths[part]) * each + bx
        full = np.bincount(group, minlength=each * (part.stop - part.start)) == size * size
        made, mine = np.zeros((int(full.sum()), size * size)), full[group]
        made[(np.cumsum(full) - 1)[group[mine]], cell[mine]] = (flat[mine] & 0xFFFFFFFF) - (1 << 31)
        of, at = np.divmod(np.flatnonzero(full), max(each, 1))
        yield part.start + of, at, made.reshape(-1, size, size).swapaxes(1, 2)


#: Squares that a kernel holds at once.
AT_ONCE = 256


def sheets(values, side: int):
    """Arrays (squares, side, side) of values and of what is there, for ``AT_ONCE`` lists of an Arrow array at a time."""
    for at in range(0, len(values), AT_ONCE):
        part = values.slice(at, AT_ONCE)
        flat = part.flatten().to_numpy()
        group = np.repeat(np.arange(len(part)), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        v, there = np.zeros((len(part), side * side)), np.zeros((len(part), side * side), bool)
        v[group, flat >> 32], there[group, flat >> 32] = (flat & 0xFFFFFFFF) - (1 << 31), True
        yield v.reshape(-1, side, side), there.reshape(-1, side, side)


def gathered(pixels: DataFrame) -> DataFrame:
    """image_id and ``columns`` (x, listed): the pixels of an image in one row, for ``images``.

    A pixel is its y times 2^32 plus the whole-numbered value, offset by 2^31. Pixels without a value are left out.
    """
    number = F.col("y").cast("long") * F.lit(1 << 32) + F.col("v").cast("long") + F.lit(1 << 31)
    columns = pixels.where("v is not null").groupBy("image_id", F.col("x").cast("int").alias("x")).agg(F.collect_list(number).alias("listed"))
    return columns.groupBy("image_id").agg(F.collect_list(F.struct("x", "listed")).alias("columns"))


#: Pixels that a kernel over whole images holds at once, if it is not one larger image.
PIXELS_AT_ONCE = 1 << 18


def chunks(pixels: np.ndarray) -> Iterator[slice]:
    """Stretches of images of about ``PIXELS_AT_ONCE`` pixels; ``pixels``: how many each one has."""
    at, end = 0, np.cumsum(pixels)
    while at < len(pixels):
        upto = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + PIXELS_AT_ONCE, side="right")))
        yield slice(at, upto)
        at = upto


def images(values: pa.Array, blank: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, images x, y) of the images of one size in a stretch of ``gathered`` columns; what is missing is ``blank``."""
    starts = np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))])
    per_column = values.flatten().field("listed").value_lengths().to_numpy(zero_copy_only=False)
    for part in chunks(np.add.reduceat(per_column, starts[:-1]) if len(values) else np.empty(0)):
        held = values.slice(part.start, part.stop - part.start)
        begin = starts[part] - starts[part.start]
        columns = held.flatten()
        x, size = columns.field("x").to_numpy(), per_column[starts[part.start] : starts[part.stop]]
        flat = columns.field("listed").flatten().to_numpy()
        y = flat >> 32
        width, height = np.maximum.reduceat(x, begin) + 1, np.maximum.reduceat(y, (np.cumsum(size) - size)[begin]) + 1
        of = np.repeat(np.repeat(np.arange(len(held)), np.diff(np.append(begin, len(x)))), size)
        for w, h in {*zip(width.tolist(), height.tolist(), strict=True)}:
            mine = (width == w) & (height == h)
            at, pick = np.cumsum(mine) - 1, mine[of]
            made = np.full((int(mine.sum()), w, h), blank)
            made[at[of[pick]], np.repeat(x, size)[pick], y[pick]] = (flat[pick] & 0xFFFFFFFF) - (1 << 31)
            yield part.start + np.flatnonzero(mine), made


def _slope(v: np.ndarray, there: np.ndarray, axis: int) -> np.ndarray:
    """Half the difference of both neighbours along an axis, the whole one of the only neighbour, or 0."""
    v, there = np.moveaxis(v, axis, 2), np.moveaxis(there, axis, 2)
    near = there[:, :, 1:] & there[:, :, :-1]
    step, total, n = np.where(near, np.diff(v), 0.0), np.zeros(v.shape), np.zeros(v.shape, np.int8)
    for part in (np.s_[:, :, 1:], np.s_[:, :, :-1]):
        total[part] += step
        n[part] += near
    return np.moveaxis(np.where(n == 2, total / 2, total), 2, axis)


def gradients(v: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both central differences of each pixel of squares, one-sided at the borders."""
    return _slope(v, there, 2), _slope(v, there, 1)
