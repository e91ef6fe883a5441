"""Entropy coding of quantized coefficients: symbols, code lengths, blocks of bytes and back.

Coefficients are rows (image_id, block, place, v) with places from 0 in each of
the three blocks. Symbols are islands of zeros and single values; bits are
packed in parallel by sums of code lengths; decoding looks at every bit offset
at once and follows the true ones by pointer doubling.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .codestream import LONGEST
from .tiles import small

# Largest value and zero run with symbols of their own, longest run, the symbol that keeps the code of ones free.
LARGEST, LONGEST_OWN, LONGEST_RUN, SENTINEL = 74, 100, 65535, 256
#: More than any symbol, so that table * CODES + symbol names a code.
CODES = 1024
# Symbols of long values and runs with the bits that follow them.
EXTRA = {101: 8, 102: 8, 103: 16, 104: 16, 105: 8, 106: 16}


def table_of(block: Column) -> Column:
    """The first block has a table of its own, the other two share one."""
    return F.when(block == 0, 0).otherwise(1)


def symbols(coefficients: DataFrame) -> DataFrame:
    """image_id, block, place, symbol, extra, n_extra (bits) of values and zero runs; runs over 65535 are cut."""
    v, line = F.col("v"), Window.partitionBy("image_id", "block", "zero").orderBy("place")
    marked = coefficients.select("image_id", "block", F.col("place").cast("long").alias("place"), F.col("v").cast("long").alias("v"), (F.col("v") == 0).alias("zero"))
    islands = marked.where("zero").withColumn("island", F.col("place") - F.row_number().over(line))
    runs = islands.groupBy("image_id", "block", "island").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    runs = runs.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(LONGEST_RUN)))).select("image_id", "block", (F.col("first") + F.col("at")).alias("place"), F.least(F.col("n") - F.col("at"), F.lit(LONGEST_RUN)).alias("n"))
    n = F.col("n")
    of_run = F.when(n <= LONGEST_OWN, n).when(n <= 255, 105).otherwise(106)
    of_value = F.when(v > 255, 103).when(v > LARGEST, 101).when(v < -255, 104).when(v < 1 - LARGEST, 102).otherwise(v + 180)
    values = marked.where("not zero").select("image_id", "block", "place", of_value.cast("int").alias("symbol"), F.abs("v").alias("extra"))
    both = runs.select("image_id", "block", "place", of_run.cast("int").alias("symbol"), n.cast("long").alias("extra")).union(values)
    bits = F.when(F.col("symbol").isin(*(s for s, b in EXTRA.items() if b == 8)), 8).when(F.col("symbol").isin(*(s for s, b in EXTRA.items() if b == 16)), 16).otherwise(0)
    return both.select("image_id", "block", "place", "symbol", F.when(bits > 0, F.col("extra")).otherwise(0).alias("extra"), bits.alias("n_extra"))


def histogram(found: DataFrame) -> DataFrame:
    """image_id, table, symbol, n of the symbols of each table, with the sentinel once."""
    counted = found.groupBy("image_id", table_of(F.col("block")).alias("table"), "symbol").agg(F.count("*").alias("n"))
    # A second pass for the sentinel would make the symbols again; a table has at most 256 of them.
    listed = counted.groupBy("image_id", "table").agg(F.collect_list(F.struct("symbol", "n")).alias("listed"))
    sentinel = F.array(F.struct(F.lit(SENTINEL).alias("symbol"), F.lit(1).cast("long").alias("n")))
    return listed.select("image_id", "table", F.inline(F.concat("listed", sentinel)))


def code_lengths(counted: list[tuple[int, int]]) -> dict[int, int]:
    """Length of the code of each symbol of (symbol, n): the two rarest trees merge, of equals those with larger symbols first."""
    heap = [(n, -symbol, [symbol]) for symbol, n in counted]
    heapq.heapify(heap)
    lengths = {symbol: 0 for symbol, _ in counted}
    while len(heap) > 1:
        n, name, members = heapq.heappop(heap)
        more, _, others = heapq.heappop(heap)
        members = members + others
        for symbol in members:
            lengths[symbol] += 1
        heapq.heappush(heap, (n + more, name, members))
    return lengths


def limited(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    """Numbers of codes of each length up to 16, and the symbols in the order of their codes.

    Where codes are longer, pairs of the longest ones move up and a shorter
    code is split for each; the sentinel counts until then, so that every
    symbol keeps a code and none is all ones.
    """
    counts = [0] * (max([LONGEST, *lengths.values()]) + 2)
    for length in lengths.values():
        counts[length] += 1
    if len(lengths) == 1:  # the sentinel alone
        return [0] * LONGEST, []
    for i in range(len(counts) - 1, LONGEST, -1):
        while counts[i] > 0:
            j = next(k for k in range(i - 2, 0, -1) if counts[k])
            counts[i] -= 2
            counts[i - 1] += 1
            counts[j + 1] += 2
            counts[j] -= 1
    counts[next(i for i in range(LONGEST, 0, -1) if counts[i])] -= 1
    return counts[1 : LONGEST + 1], sorted((s for s in lengths if s != SENTINEL), key=lambda s: (lengths[s], s))


def tables(counted: DataFrame) -> DataFrame:
    """image_id, table, ``counts`` (codes of each length from 1 to 16) and ``symbols`` in the order of their codes."""
    rows = counted.groupBy("image_id", "table").agg(F.array_sort(F.collect_list(F.struct("symbol", "n"))).alias("counted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [limited(code_lengths([(x["symbol"], x["n"]) for x in row])) for row in batch.column(2).to_pylist()]
            arrays = [pa.array([m[i] for m in made], pa.list_(pa.int32())) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["image_id", "table", "counts", "symbols"])

    return rows.select(F.col("image_id").cast("long"), F.col("table").cast("int"), "counted").mapInArrow(run, "image_id bigint, table int, counts array<int>, symbols array<int>")


def codes(found: DataFrame) -> DataFrame:
    """image_id, table, symbol, length and canonical ``code`` of tables."""
    lengths = F.flatten(F.transform("counts", lambda n, i: F.array_repeat(i + 1, n)))
    rows = found.select("image_id", "table", "symbols", F.posexplode(lengths).alias("place", "length"))
    before = Window.partitionBy("image_id", "table").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.expr(f"shiftleft(1L, {LONGEST} - length)")).over(before), F.lit(0))
    return rows.withColumn("taken", taken).select("image_id", "table", F.get("symbols", F.col("place")).alias("symbol"), "length", F.expr(f"shiftright(taken, {LONGEST} - length)").alias("code"))


def blocks(found: DataFrame, coded: DataFrame) -> DataFrame:
    """image_id, block, ``data``: the packed bytes of symbols; a byte FF is followed by 00, the last byte is filled with ones.

    Every symbol adds its bits to the bytes that it touches; places come from
    running sums, so no task writes a block bit by bit.
    """
    # All codes of an image are one row, so symbols are joined where they lie and need no shuffle.
    of_image = coded.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("table") * CODES + F.col("symbol"), F.struct("length", "code")))).alias("codes"))
    rows = found.withColumn("table", table_of(F.col("block"))).join(small(of_image), "image_id")
    rows = rows.withColumn("c", F.try_element_at("codes", F.col("table") * CODES + F.col("symbol"))).where("c is not null").select("image_id", "block", "place", "extra", "n_extra", "c.*")
    rows = rows.select("image_id", "block", "place", (F.expr("shiftleft(code, n_extra)") + F.col("extra")).alias("bits"), (F.col("length") + F.col("n_extra")).cast("long").alias("n"))
    line = Window.partitionBy("image_id", "block").orderBy("place")
    rows = rows.withColumn("end", F.sum("n").over(line)).withColumn("byte", F.explode(F.sequence(F.floor((F.col("end") - F.col("n")) / 8), F.floor((F.col("end") - 1) / 8))))
    shift = ((F.col("byte") + 1) * 8 - F.col("end")).cast("int")
    part = F.when(shift >= 0, F.expr("shiftleft(bits, shift)")).otherwise(F.expr("shiftright(bits, -shift)")).bitwiseAND(F.lit(255))
    each = rows.withColumn("shift", shift).groupBy("image_id", "block", "byte").agg(F.bit_or(part).alias("value"), F.max("end").alias("end"))
    # Only the last byte of a block is not full.
    spare = F.greatest((F.col("byte") + 1) * 8 - F.max("end").over(Window.partitionBy("image_id", "block")), F.lit(0)).cast("int")
    each = each.withColumn("spare", spare).withColumn("value", F.expr("value | (shiftleft(1L, spare) - 1)"))
    text = F.when(F.col("value") == 255, "FF00").otherwise(F.lpad(F.hex("value"), 2, "0"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("byte", text.alias("text")))), lambda b: b.text)
    return each.groupBy("image_id", "block").agg(F.unhex(F.array_join(joined, "")).alias("data"))


@lru_cache(maxsize=64)
def _lookup(counts: tuple[int, ...], values: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol (-1: none) and code length for each 16 bits that may follow."""
    length = np.repeat(np.arange(1, LONGEST + 1), counts)
    width = 1 << (LONGEST - length)
    symbol, size = np.full(1 << LONGEST, -1, np.int32), np.zeros(1 << LONGEST, np.int32)
    n = min(int(width.sum()), 1 << LONGEST)
    symbol[:n], size[:n] = np.repeat(np.array(values, np.int32), width)[:n], np.repeat(length, width)[:n]
    return symbol, size


def decoded(data: bytes, counts: tuple[int, ...], values: tuple[int, ...], wanted: int) -> tuple[list[int], list[int], str | None]:
    """(symbols, extra values, error) of a block of ``wanted`` coefficients.

    Each bit offset gets the symbol that would start there and the offset after
    it; those on the way from offset 0 are found by doubling the jumps.
    Errors: ``escape`` and ``marker`` (bytes after FF), ``code`` (bits without a
    symbol), ``symbol`` (one that is not defined), ``end`` (too few bits), ``run`` (too
    many zeros).
    """
    if not wanted:
        return [], [], "data" if data else None
    raw = np.frombuffer(data, np.uint8)
    after = np.flatnonzero(raw == 255) + 1
    if len(after) and after[-1] >= len(raw):
        return [], [], "escape"
    if raw[after].any():
        return [], [], "marker"
    raw = np.delete(raw, after)
    total = 8 * len(raw)
    wide = np.concatenate([raw, np.full(6, 255, np.uint8)]).astype(np.int32)
    three = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:])[: len(raw) + 4]
    window = (three[:, None] >> (8 - np.arange(8)) & 0xFFFF).reshape(-1)
    symbol, size = (x[window[:total]] for x in _lookup(counts, values))
    extra = np.zeros(257, np.int64)
    extra[list(EXTRA)] = list(EXTRA.values())
    more = extra[symbol]
    end = np.arange(total) + size + more
    jump = np.append(np.where((symbol >= 0) & (end <= total), end, total), total)
    on = np.zeros(total + 1, bool)
    on[0] = True
    while jump[0] < total:
        on[jump[on]] = True
        jump = jump[jump]
    on[jump[on]] = True
    at = np.flatnonzero(on[:total])
    value = np.where(more[at] > 0, window[at + size[at]] >> (16 - more[at]), 0)
    covers = np.where((symbol[at] >= 1) & (symbol[at] <= LONGEST_OWN), symbol[at], np.where(symbol[at] >= 105, np.where(symbol[at] <= 106, value, 1), 1))
    filled = np.cumsum(covers)
    used = int(np.searchsorted(filled, wanted)) + 1
    at, value = at[:used], value[:used]
    bad = np.flatnonzero((symbol[at] < 1) | (symbol[at] == 255) | (end[at] > total))
    if len(bad):
        k = at[bad[0]]
        return [], [], "symbol" if symbol[k] in (0, 255) else "end" if end[k] > total or k + LONGEST > total else "code"
    if used > len(filled):
        return [], [], "end"
    return ([], [], "run") if filled[used - 1] > wanted else (symbol[at].tolist(), value.tolist(), None)


def coefficients(packed: DataFrame, found: DataFrame) -> DataFrame:
    """image_id, block, place, v, error of blocks (image_id, block, data, n: coefficients) and their ``tables``.

    A block that breaks a rule is one row with ``error`` (see ``decoded``; ``table``: it has none).
    """
    out = pa.schema([("image_id", pa.int64()), ("block", pa.int32()), ("symbols", pa.list_(pa.int32())), ("extras", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("error", pa.string())])

    def ends(symbols: list[int], extras: list[int]) -> np.ndarray:
        symbol = np.array(symbols, np.int64)
        return np.cumsum(np.where(symbol <= LONGEST_OWN, symbol, np.where((symbol == 105) | (symbol == 106), np.array(extras, np.int64), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, n, counts, values in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                symbols, extras, error = decoded(data or b"", tuple(counts or ()), tuple(values or ()), n) if counts is not None or not n else ([], [], "table")
                rows.append((symbols, extras, ends(symbols, extras), error))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t.type) for i, t in enumerate(list(out)[2:]))], schema=out)

    # The tables of an image are one row, held where its blocks lie.
    of_image = found.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("table", F.struct("counts", "symbols")))).alias("tables"))
    rows = packed.join(small(of_image), "image_id", "left").withColumn("t", F.try_element_at("tables", table_of(F.col("block"))))
    rows = rows.select(F.col("image_id").cast("long"), F.col("block").cast("int"), "data", F.col("n").cast("int"), "t.counts", "t.symbols")
    each = rows.mapInArrow(run, "image_id bigint, block int, symbols array<int>, extras array<bigint>, ends array<bigint>, error string")
    # Failed blocks are an entry without a symbol, so the blocks are decoded once for both.
    entries = F.when(F.col("error").isNull(), F.arrays_zip("symbols", "extras", "ends")).otherwise(F.array(F.struct(F.lit(None).cast("int").alias("symbols"), F.lit(None).cast("long").alias("extras"), F.lit(None).cast("long").alias("ends"))))
    listed = each.select("image_id", "block", "error", F.inline(entries))
    symbol, extra = F.col("symbols"), F.col("extras")
    n = F.when(symbol <= LONGEST_OWN, symbol).when(symbol.isin(105, 106), extra).otherwise(1).cast("long")
    v = F.when(symbol.isin(101, 103), extra).when(symbol.isin(102, 104), -extra).when(symbol > 106, symbol - 180).when(symbol.isNotNull(), 0).cast("int")
    placed = listed.select("image_id", "block", n.alias("n"), v.alias("v"), F.col("ends").alias("end"), "error").where("n > 0")
    place = F.explode_outer(F.when(F.col("error").isNull(), F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)))
    return placed.select("image_id", "block", place.alias("place"), "v", "error")
