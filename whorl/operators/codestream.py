"""Segments and tables of compressed image files.

A file is a row (path, content). ``segments`` walks its markers, one row a
segment; all that follows are column functions, groupings and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import images, measures

# The markers of the format.
START, END, FRAME, BLOCK, TRANSFORM, QUANTIZATION, HUFFMAN, RESTART, COMMENT = range(0xFFA0, 0xFFA9)
# First subband of the second and third block, and the end; quantization slots; longest code.
BOUNDS, SLOTS, LONGEST = (19, 52, 60), 64, 16


def big_endian(value: Column, n_bytes: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * n_bytes, "0"))


def unsigned(data: Column, at: Column | int, n_bytes: int) -> Column:
    """Big-endian number of ``n_bytes`` bytes from the 0-based place ``at`` on; null beyond the end."""
    part = F.substring(data, (at if isinstance(at, Column) else F.lit(at)) + 1, F.lit(n_bytes))
    return F.when(F.octet_length(part) == n_bytes, F.conv(F.hex(part), 16, 10).cast("long"))


def decimal(data: Column, at: Column | int, n_bytes: int) -> Column:
    """Number stored as a byte of decimal places and a raw value of ``n_bytes`` bytes."""
    return unsigned(data, at + 1, n_bytes) / F.pow(F.lit(10.0), unsigned(data, at, 1))


def segment(marker: int, payload: Column) -> Column:
    """Bytes of a marker, the length and the payload."""
    return F.concat(F.lit(marker.to_bytes(2, "big")), big_endian(F.octet_length(payload) + 2, 2), payload)


def segments(files: DataFrame) -> DataFrame:
    """path, segment, marker, byte_offset, ``payload``, ``tables`` (of a Huffman segment), ``n_data`` (of a block), error.

    A file that breaks a rule ends in a row with ``error``: ``start`` (it begins
    otherwise), ``marker`` (unknown), ``order`` (not allowed here), ``length``
    (a segment below two bytes or beyond the end), ``block`` (header of another
    size), ``table`` (not defined before), ``huffman`` (cut off) or ``data`` (no
    marker after a block). Bytes behind the end marker are ignored; null and
    empty files give ``start``.
    """

    def walk(data: bytes) -> Iterator[tuple]:
        import re

        marked, at, framed, known, number = re.compile(rb"\xff[^\x00]", re.S), 2, False, set(), 1
        if data[:2] != START.to_bytes(2, "big"):
            yield 0, None, 0, None, None, None, "start"
            return
        yield 0, START, 0, b"", None, None, None
        while True:
            marker, begin = int.from_bytes(data[at : at + 2], "big"), at
            size, payload, tables, n_data, error = int.from_bytes(data[at + 2 : at + 4], "big"), None, None, None, None
            if len(data) < at + 2 or not START <= marker <= COMMENT:
                error = "marker"
            elif marker not in (TRANSFORM, QUANTIZATION, HUFFMAN, COMMENT, *((BLOCK, END) if framed else (FRAME,))):
                error = "order"
            elif marker == END:
                yield number, marker, begin, b"", None, None, None
                return
            elif size < 2 or len(data) < at + 2 + size:
                error = "length"
            else:
                payload, at = data[at + 4 : at + 2 + size], at + 2 + size
                framed = framed or marker == FRAME
                if marker == HUFFMAN:
                    tables, p = [], 0
                    while p < len(payload):
                        end = p + 1 + LONGEST + sum(payload[p + 1 : p + 1 + LONGEST])
                        if end > len(payload):
                            error = "huffman"
                            break
                        tables.append(payload[p:end])
                        known.add(payload[p])
                        p = end
                elif marker == BLOCK:
                    found = marked.search(data, at)
                    error = "block" if len(payload) != 1 else "table" if payload[0] not in known else None if found else "data"
                    if not error:
                        n_data, at = found.start() - at, found.start()
            yield number, marker, begin, payload, tables, n_data, error
            if error:
                return
            number += 1

    def run(batches):
        import pyarrow as pa

        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.string()]
        names = ["path", "segment", "marker", "byte_offset", "payload", "tables", "n_data", "error"]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(path, *row) for row in walk(content.as_py() or b"")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    schema = "path string, segment int, marker int, byte_offset bigint, payload binary, tables array<binary>, n_data bigint, error string"
    return files.select(F.col("path").cast("string"), "content").mapInArrow(run, schema)


def inspect(found: DataFrame) -> DataFrame:
    """One row per file of ``segments``: frame, filter lengths, bin centre, table ids, blocks, comments and error.

    Of repeated tables the last one counts; a file without a transform or
    quantization table has the error ``transform`` or ``quantization``. A file
    with an error has no other values.
    """
    of = lambda marker: F.max_by("payload", F.when(F.col("marker") == marker, F.col("segment")))
    text = F.when(F.col("marker") == COMMENT, F.decode("payload", "ISO-8859-1"))
    stated = images.comment_value(text, "PPI").try_cast("int")
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("tables", lambda t: unsigned(t, 0, 1))))))
    rows = found.groupBy("path").agg(
        F.max("error").alias("error"), of(FRAME).alias("frame"), of(TRANSFORM).alias("transform"), of(QUANTIZATION).alias("bins"), ids.alias("table_ids"),
        F.count("n_data").alias("n_blocks"), F.coalesce(F.sum("n_data"), F.lit(0)).alias("n_block_bytes"), F.count(text).alias("n_comments"),
        F.count_if(F.startswith(text, F.lit("NIST_COM"))).alias("n_nist_comments"), F.coalesce(F.min_by(stated, F.when(stated.isNotNull(), F.col("segment"))), F.lit(500)).alias("ppi"),
    )
    error = F.coalesce("error", F.when(F.col("transform").isNull(), "transform"), F.when(F.col("bins").isNull(), "quantization"))
    frame, places = F.col("frame"), {"black": (0, 1), "white": (1, 1), "height": (2, 2), "width": (4, 2), "encoder": (12, 1), "software": (13, 2)}
    values = {k: unsigned(frame, at, n) for k, (at, n) in places.items()} | {"shift": decimal(frame, 6, 2), "scale": decimal(frame, 9, 2)}
    values |= {"high_pass": unsigned(F.col("transform"), 0, 1), "low_pass": unsigned(F.col("transform"), 1, 1), "bin_center": decimal(F.col("bins"), 0, 2)}
    values |= {c: F.col(c) for c in ("table_ids", "n_blocks", "n_block_bytes", "n_comments", "n_nist_comments", "ppi")}
    return rows.select("path", error.alias("error"), *(F.when(error.isNull(), v).alias(k) for k, v in values.items()))


def filters(payload: Column) -> Column:
    """Struct (high, low) of the filter taps of a transform table, from their stored halves.

    The first length governs the first half. Odd filters mirror around the
    middle; even ones mirror between the middle taps, the high one with the
    sign turned. Signs alternate from the middle on.
    """
    n_high, n_low = unsigned(payload, 0, 1), unsigned(payload, 1, 1)
    half = lambda n: (n + 1 - (n + 1) % 2) / 2

    def taps(n: Column, begin: Column, high: bool) -> Column:
        def tap(j: Column) -> Column:
            middle, odd = half(n).cast("int") - 1, n % 2 == 1
            right = F.when(odd, j >= middle).otherwise(j > middle)
            i = F.when(~right, middle - j).when(odd, j - middle).otherwise(j - middle - 1)
            at = (begin + 6 * i).cast("int")
            stored = decimal(payload, at + 1, 4) * F.when(unsigned(payload, at, 1) == 0, 1).otherwise(-1)
            turned = F.when(odd, i % 2).otherwise((i + F.when(right, 0).otherwise(1) if high else i + 1) % 2)
            return stored * F.when(turned == 0, 1).otherwise(-1)

        return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), tap)

    return F.struct(taps(n_high, F.lit(2), True).alias("high"), taps(n_low, 2 + 6 * half(n_high), False).alias("low"))


def bins(payload: Column) -> Column:
    """Array of (q, z), the bin and zero bin of each of the 64 slots of a quantization table."""
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.struct(decimal(payload, 3 + 6 * i, 2).alias("q"), decimal(payload, 6 + 6 * i, 2).alias("z")))


def bins_payload(q: Column, z: Column, center: float = 0.44) -> Column:
    """Quantization table of arrays of bins and zero bins; missing slots are 0, a bin that is too large gives null."""
    stored = lambda raw, scale: F.concat(F.lpad(F.hex(scale.cast("long")), 2, "0"), F.lpad(F.hex(raw.cast("long")), 4, "0"))
    values = F.flatten(F.zip_with(q, z, lambda a, b: F.array(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))))
    values = F.concat(values, F.array_repeat(F.lit(0.0), F.lit(2 * SLOTS) - F.size(values)))
    slots = F.transform(F.transform(values, lambda v: measures.scaled(v)), lambda s: stored(s["raw"], s["scale"]))
    return F.unhex(F.aggregate(slots, stored(F.lit(round(center * 100)), F.lit(2)), lambda done, slot: F.concat(done, slot)))


def huffman_codes(found: DataFrame) -> DataFrame:
    """path, segment, table, table_id, place, ``value``, ``length`` and canonical ``code`` of all tables of ``segments``."""
    table = found.where("tables is not null").select("path", "segment", F.posexplode("tables").alias("table", "data"))
    lengths = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda n: F.array_repeat(n, unsigned(F.col("data"), n, 1).cast("int"))))
    rows = table.select("path", "segment", "table", "data", unsigned(F.col("data"), 0, 1).alias("table_id"), F.posexplode(lengths).alias("place", "length"))
    # Each earlier code takes its share of the space of the longest codes.
    before = Window.partitionBy("path", "segment", "table").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.expr(f"shiftleft(1L, {LONGEST} - length)")).over(before), F.lit(0))
    rows = rows.withColumn("taken", taken)
    return rows.select("path", "segment", "table", "table_id", "place", unsigned(F.col("data"), 1 + LONGEST + F.col("place"), 1).alias("value"), "length", F.expr(f"shiftright(taken, {LONGEST} - length)").alias("code"))


def block_sizes(subbands: DataFrame) -> DataFrame:
    """image_id, block, ``n``: coefficients of each of the three blocks; ``subbands`` has image_id, subband, width, height, q.

    Subbands whose bin is 0 in single precision hold none.
    """
    block = F.when(F.col("subband") < BOUNDS[0], 0).when(F.col("subband") < BOUNDS[1], 1).otherwise(2)
    area = F.when(F.col("q").cast("float") != 0, F.col("width").cast("long") * F.col("height")).otherwise(0)
    return subbands.where(F.col("subband") < BOUNDS[2]).groupBy("image_id", block.alias("block")).agg(F.sum(area).alias("n"))
