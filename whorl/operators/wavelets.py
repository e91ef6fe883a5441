"""Wavelet and quantization trees, and the multi-level transform over them.

Trees are a table of paths: every node halves the width and the height along a
path of its own, so all sizes are split by column expressions. The transform
gathers the lines of each image once; on each of the five levels the parts of the
rows that belong to the level's nodes are filtered, then those of the columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import lines, mirrored

# The analysis filters of the format, from their first tap to the middle.
LOW_HALF = (0.03782845550699546, -0.02384946501938000, -0.11062440441842342, 0.37740285561265380, 0.85269867900940344)
HIGH_HALF = (0.06453888262893845, -0.04068941760955844, -0.41809227322221221, 0.78848561640566439)
LOW, HIGH = ((*half, *half[-2::-1]) for half in (LOW_HALF, HIGH_HALF))
# Nodes whose rows or columns hold the high half first.
TURNED_ROWS, TURNED_COLUMNS = (2, 4, 7, 9, 11, 13, 16, 18), (3, 5, 8, 9, 12, 13, 17, 18)
LEVELS = ((0,), (1, 2, 3), (4, 5, 14), (6, 7, 8, 9, 10, 11, 12, 13, 15, 16, 17, 18), (19,))


def paths() -> list[tuple[str, int, str, str]]:
    """(kind, node, x path, y path) of the 20 wavelet nodes and the 64 slots.

    A path halves a length step by step: ``f`` and ``s`` take the first and
    the second half where the first gets the odd one, ``F`` and ``S`` where the
    second gets it.
    """
    quarter = lambda x, y: [(x[i % 2], y[i // 2]) for i in range(4)]
    nodes = {0: ("", ""), 1: ("f", "f"), 2: ("s", "f"), 3: ("f", "s"), 4: ("fs", "ff"), 5: ("ff", "fs"), 14: ("ff", "ff"), 19: ("ffff", "ffff")}
    for first, parent, x, y in ((6, 4, "FS", "fs"), (10, 5, "fs", "FS"), (15, 14, "fs", "fs")):
        nodes |= {first + i: (nodes[parent][0] + a, nodes[parent][1] + b) for i, (a, b) in enumerate(quarter(x, y))}
    slots = {}
    # Sixteen parts each; later regions take over the slots that they share with earlier ones.
    for first, parent, x, y in ((3, 14, "fs", "fs"), (19, 4, "FS", "fs"), (48, 0, "fs", "fs"), (35, 5, "fs", "FS")):
        for i, (a, b) in enumerate(quarter(x, y)):
            # The half nearer to the middle keeps the odd one.
            inner = quarter(*("FS" if half in "sS" else "fs" for half in (a, b)))
            slots |= {first + 4 * i + j: (nodes[parent][0] + a + c, nodes[parent][1] + b + d) for j, (c, d) in enumerate(inner)}
    slots |= {i: (nodes[19][0] + a, nodes[19][1] + b) for i, (a, b) in enumerate(quarter("fs", "fs"))}
    return [(kind, k, *v) for kind, table in (("node", nodes), ("slot", slots)) for k, v in sorted(table.items())]


def _left(path: Column, length: Column) -> Column:
    """Struct (at, n): place and length of what a path leaves of a length."""

    def halve(s: Column, step: Column) -> Column:
        larger, smaller = F.floor((s.n + 1) / 2).cast("int"), F.floor(s.n / 2).cast("int")
        first = F.when(step.isin("f", "s"), larger).otherwise(smaller)
        late = step.isin("s", "S")
        return F.struct(F.when(late, s.at + first).otherwise(s.at).alias("at"), F.when(late, s.n - first).otherwise(first).alias("n"))

    return F.aggregate(F.filter(F.split(path, ""), lambda c: c != ""), F.struct(F.lit(0).alias("at"), length.cast("int").alias("n")), halve)


def trees(sizes: DataFrame) -> DataFrame:
    """width, height, kind, node, x, y, node_width, node_height, turned_rows, turned_columns of every distinct size."""
    return placed(sizes.select("width", "height").distinct())


def placed(sizes: DataFrame) -> DataFrame:
    """The trees of every row; its own columns stay."""
    nodes = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(node).alias("node"), F.lit(x).alias("x_path"), F.lit(y).alias("y_path")) for kind, node, x, y in paths()))
    rows = sizes.select("*", F.inline(nodes))
    rows = rows.withColumns({"ax": _left(F.col("x_path"), F.col("width")), "ay": _left(F.col("y_path"), F.col("height"))})
    flag = lambda chosen: (F.col("kind") == "node") & F.col("node").isin(*chosen)
    return rows.select(*sizes.columns, "kind", "node", F.col("ax.at").alias("x"), F.col("ay.at").alias("y"), F.col("ax.n").alias("node_width"), F.col("ay.n").alias("node_height"), flag(TURNED_ROWS).alias("turned_rows"), flag(TURNED_COLUMNS).alias("turned_columns"))


def analysed(m: np.ndarray, swap: bool) -> np.ndarray:
    """Low and high half of lines, high first with ``swap``; the ends are mirrored, the low half has the odd one."""
    n = m.shape[1]
    low = m[:, mirrored(2 * np.arange((n + 1) // 2)[:, None] + np.arange(len(LOW)) - len(LOW) // 2, n)] @ np.array(LOW)
    high = m[:, mirrored(2 * np.arange(n // 2)[:, None] + 1 + np.arange(len(HIGH)) - len(HIGH) // 2, n)] @ np.array(HIGH)
    return np.concatenate([high, low] if swap else [low, high], axis=1)


def joined(m: np.ndarray, swap: bool) -> np.ndarray:
    """Lines from their halves: the inverse of ``analysed``."""
    n = m.shape[1]
    if n == 1:
        return m / sum(LOW)
    cut = n // 2 if swap else (n + 1) // 2
    mixed = np.empty_like(m)
    mixed[:, 0::2], mixed[:, 1::2] = (m[:, cut:], m[:, :cut]) if swap else (m[:, :cut], m[:, cut:])
    reach = np.arange(len(LOW)) - len(LOW) // 2
    sign = np.where(reach % 2, -1.0, 1.0)
    from_low, from_high = sign * np.pad(HIGH, (len(LOW) - len(HIGH)) // 2), sign * np.array(LOW)
    place = np.arange(n)[:, None] + reach
    weight = np.where(place % 2 == 0, from_low, from_high)
    return np.einsum("lnk,nk->ln", mixed[:, mirrored(place, n)], weight)


def _places(level: tuple[int, ...], along: str, width: int, height: int) -> list[tuple[int, int, int, int, bool]]:
    """(x, y, width, height, swap) of the nodes of a level; ``along``: x for rows, y for columns."""
    turned = TURNED_ROWS if along == "x" else TURNED_COLUMNS
    of = {node: (x, y) for kind, node, x, y in paths() if kind == "node"}
    return [(*(v for pair in zip(halved(of[k][0], width), halved(of[k][1], height), strict=True) for v in pair), k in turned) for k in level]


def halved(path: str, n: int) -> tuple[int, int]:
    """Place and length of what a path leaves of a length."""
    at = 0
    for step in path:
        first = (n + 1) // 2 if step in "fs" else n // 2
        at, n = (at + first, n - first) if step in "sS" else (at, first)
    return at, n


def _sheets(pixels: DataFrame, value: str) -> DataFrame:
    """image_id, ``height`` and ``v``: the lines of an image one after the other."""
    rows = lines(pixels, "x", value).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("line", "v"))).alias("rows"))
    return rows.select("image_id", F.size("rows").alias("height"), F.flatten(F.col("rows").v).alias("v"))


def _run(sheets: DataFrame, steps: list, kernel, value: str = "v") -> DataFrame:
    """``sheets`` with ``value`` after the steps (level, along) in order: an image is filtered as a whole."""

    @F.pandas_udf("array<double>")
    def run(values, heights):
        import pandas as pd

        out, of = [None] * len(values), {}
        for i, (row, height) in enumerate(zip(values, heights, strict=True)):
            of.setdefault((len(row) // height, height), []).append(i)
        for (width, height), places in of.items():
            made = np.stack([values.iloc[i] for i in places]).astype(float).reshape(-1, height, width)
            for level, along in steps:
                for x, y, w, h, swap in _places(level, along, width, height):
                    part = made[:, y : y + h, x : x + w]
                    if not part.size:
                        continue
                    if along == "x":
                        part[:] = kernel(part.reshape(-1, w), swap).reshape(part.shape)
                    else:
                        part[:] = kernel(part.transpose(0, 2, 1).reshape(-1, h), swap).reshape(-1, w, h).transpose(0, 2, 1)
            for i, row in zip(places, made.reshape(len(places), -1), strict=True):
                out[i] = row
        return pd.Series(out)

    return sheets.withColumn(value, run(value, "height"))


def _long(sheets: DataFrame, value: str = "c") -> DataFrame:
    """image_id, x, y and the value of each pixel."""
    width = F.col("width")
    each = sheets.select("image_id", F.floor(F.size("v") / F.col("height")).alias("width"), F.posexplode("v").alias("i", value))
    return each.select("image_id", (F.col("i") % width).cast("int").alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), value)


def _steps(levels: tuple) -> list:
    """Both axes of every level; which one comes first alternates, as they commute."""
    return [(level, axis) for i, level in enumerate(levels) for axis in ("xy" if i % 2 == 0 else "yx")]


def decompose(pixels: DataFrame, levels: tuple = LEVELS, value: str = "c") -> DataFrame:
    """image_id, x, y, c: the coefficients of full rasters (image_id, x, y and ``value``), in double precision."""
    return _long(_run(_sheets(pixels, value), _steps(levels), analysed))


def reconstruct(coefficients: DataFrame, levels: tuple = LEVELS, value: str = "c") -> DataFrame:
    """image_id, x, y, c: the raster of the coefficients."""
    return _long(_run(_sheets(coefficients, value), _steps(levels)[::-1], joined))


def round_trip(pixels: DataFrame, levels: tuple = LEVELS, value: str = "c") -> DataFrame:
    """image_id, ``v`` and ``back``: the values of full rasters line by line, and what ``reconstruct`` makes of ``decompose``.

    Both lie in one row, so no pixel is joined.
    """
    there = _run(_sheets(pixels, value).withColumn("back", F.col("v")), _steps(levels), analysed, "back")
    return _run(there, _steps(levels)[::-1], joined, "back").select("image_id", "v", "back")


def slots_of(coefficients: DataFrame, value: str = "c") -> DataFrame:
    """image_id, slot, row (0-based in the slot) and ``v``: the coefficients of each slot, row by row.

    Each row of a slot meets one line of its image; empty slots have no rows.
    """
    size = coefficients.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))
    slots = placed(size).where("kind = 'slot' and node_width > 0 and node_height > 0").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("node_height") - 1)))
    asked = slots.select("image_id", F.col("node").alias("slot"), "row", (F.col("y") + F.col("row")).alias("line"), "x", "node_width")
    return lines(coefficients, "x", value).join(asked.hint("merge"), ["image_id", "line"]).select("image_id", "slot", "row", F.slice("v", F.col("x") + 1, F.col("node_width")).alias("v"))
