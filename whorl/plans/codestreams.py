"""Queries of compressed image files made by rule from ``part``, with their SQL.

Every seventh file or so breaks a rule. Each SQL is written from the base columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import codestream as cs
from ..operators import dumps


def _key() -> Column:
    return F.col("p_partkey")


def _transform() -> Column:
    """Filters of 9 and 7 taps (odd keys) or 8 and 6 (even keys); tap i is (p_size + i) / 100, odd ones negative."""
    odd = _key() % 2 == 1
    tap = lambda i: F.concat(cs.big_endian(i % 2, 1), F.lit(b"\x02"), cs.big_endian(F.col("p_size") + i, 4))
    half = lambda n: F.concat(*(tap(F.lit(i)) for i in range(n)))
    return F.when(odd, F.concat(F.lit(b"\x09\x07"), half(5), half(4))).otherwise(F.concat(F.lit(b"\x08\x06"), half(4), half(3)))


def _bins() -> Column:
    q = F.transform(F.sequence(F.lit(0), F.lit(cs.SLOTS - 1)), lambda i: (F.col("p_size") + i) / 8.0)
    return cs.bins_payload(q, F.transform(q, lambda v: v * 1.2))


def _huffman() -> Column:
    """Two tables: 1 or 2 codes of two bits, two of three and up to three of five; values from 10 on."""
    counts = [F.lit(0), 1 + _key() % 2, F.lit(2), F.lit(0), _key() % 4, *[F.lit(0)] * 11]
    n = (3 + _key() % 2 + _key() % 4).cast("int")
    values = F.substring(F.lit(bytes(range(10, 20))), F.lit(1), n)
    return F.concat(*(x for table in (0, 1) for x in (cs.big_endian(F.lit(table), 1), *(cs.big_endian(c, 1) for c in counts), values)))


def _frame() -> Column:
    number = lambda c, n: cs.big_endian(c, n)
    parts = [(F.lit(0), 1), (F.lit(255), 1), (_key() % 500 + 1, 2), (F.col("p_size"), 2), (F.lit(1), 1), (_key() % 1000, 2), (F.lit(2), 1), (F.col("p_size"), 2), (_key() % 3, 1), (_key() % 60000, 2)]
    return F.concat(*(number(c, n) for c, n in parts))


def _files(spark, sf_dir: str) -> DataFrame:
    comment = F.encode(F.when(_key() % 3 == 0, "NIST_COM 2\nPPI 250\n").when(_key() % 3 == 1, "NIST_COM 1\nCOLORSPACE GRAY\n").otherwise(F.concat(F.lit("PPI 100 of "), F.col("p_brand"))), "ISO-8859-1")
    data = F.encode(F.replace(F.decode(F.unhex(F.md5(_key().cast("string").cast("binary"))), "ISO-8859-1"), F.lit("ÿ"), F.lit("ÿ\x00")), "ISO-8859-1")
    frame = F.when(_key() % 7 == 1, F.lit(b"")).otherwise(cs.segment(cs.FRAME, _frame()))
    block = F.concat(cs.segment(cs.BLOCK, F.when(_key() % 7 == 2, F.lit(b"\x09")).otherwise(F.lit(b"\x01"))), data)
    content = F.concat(
        F.when(_key() % 7 == 0, F.lit(b"\xff\xa1")).otherwise(F.lit(b"\xff\xa0")), cs.segment(cs.COMMENT, comment), cs.segment(cs.TRANSFORM, _transform()),
        F.when(_key() % 7 == 4, F.lit(b"")).otherwise(cs.segment(cs.QUANTIZATION, F.col("bins"))), cs.segment(cs.HUFFMAN, _huffman()), frame, block, block, F.when(_key() % 7 == 3, F.lit(b"")).otherwise(F.lit(b"\xff\xa1")),
    )
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_brand").repartition("p_partkey")
    return parts.withColumn("bins", _bins()).select(_key().alias("path"), content.alias("content"))


def s3_inspect(spark, sf_dir):
    found = cs.inspect(cs.segments(_files(spark, sf_dir)))
    numbers = [c for c, kind in found.dtypes if kind in ("int", "bigint")]
    return found.select(F.col("path").cast("long").alias("path"), "error", "shift", "scale", "bin_center", F.array_join("table_ids", ",").alias("table_ids"), *(F.coalesce(F.col(c), F.lit(-1)).cast("long").alias(c) for c in numbers))


def w2_segments(spark, sf_dir):
    found = cs.segments(_files(spark, sf_dir))
    return found.select(F.col("path").cast("long").alias("path"), F.col("segment").cast("long").alias("segment"), F.coalesce("marker", F.lit(0)).cast("long").alias("marker"), "error")


def w6_filters(spark, sf_dir):
    found = cs.segments(_files(spark, sf_dir)).where(F.col("marker") == cs.TRANSFORM).select("path", cs.filters(F.col("payload")).alias("f"))
    sides = F.inline(F.array(*(F.struct(F.lit(c).alias("filter"), F.col(f"f.{c}").alias("taps")) for c in ("high", "low"))))
    taps = found.select(F.col("path").cast("long").alias("path"), sides).select("path", "filter", F.posexplode("taps").alias("j", "tap"))
    return taps.select("path", "filter", F.col("j").cast("long").alias("j"), F.round("tap", 6).alias("tap"))


def w7_bins(spark, sf_dir):
    found = cs.segments(_files(spark, sf_dir)).where(F.col("marker") == cs.QUANTIZATION)
    rows = found.select(F.col("path").cast("long").alias("path"), F.posexplode(cs.bins(F.col("payload"))).alias("i", "bin"))
    return rows.select("path", F.col("i").cast("long").alias("i"), F.round("bin.q", 6).alias("q"), F.round("bin.z", 6).alias("z"))


def w9_codes(spark, sf_dir):
    found = cs.huffman_codes(cs.segments(_files(spark, sf_dir)))
    return found.select(*(F.col(c).cast("long").alias(c) for c in ("path", "table_id", "value", "length", "code")))


def w13_blocks(spark, sf_dir):
    bands = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("subband"))
    s = F.col("subband")
    bands = bands.select(_key().alias("image_id"), s, (F.col("p_size") + s).alias("width"), (_key() % 9 + 1).alias("height"), F.when((_key() + s) % 5 == 0, 0.0).otherwise(1.5).alias("q"))
    found = cs.block_sizes(bands)
    return found.select("image_id", F.col("block").cast("long").alias("block"), "n")


def c10_differences(spark, sf_dir):
    """Digests of parts and copies with two bytes changed, of which every fifth has two more at its end."""
    parts, key = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    content = F.md5(key.cast("string").cast("binary"))
    at = lambda text, place, byte: F.overlay(text, F.lit(byte), (2 * place + 1).cast("int"), F.lit(2))
    changed = at(at(content, key % 16, "ff"), key * 3 % 16, "00")
    copy = F.when(key % 5 == 0, F.concat(changed, F.lit("abcd"))).otherwise(changed)
    found = dumps.byte_differences(parts.select(key.alias("path"), F.unhex(content).alias("content")), parts.select(key.alias("path"), F.unhex(copy).alias("content")))
    return found.select(F.col("path").cast("long").alias("path"), "byte_offset", "length", F.lower(F.hex("expected")).alias("expected"), F.lower(F.hex("actual")).alias("actual"))


QUERIES = {f.__name__: f for f in (c10_differences, s3_inspect, w2_segments, w6_filters, w7_bins, w9_codes, w13_blocks)}

_GOOD = "p_partkey % 7 > 4"
_FF = "len(list_filter(range(16), lambda i: substr(md5(p_partkey::varchar), 2 * i::int + 1, 2) = 'ff'))"
_VALUES = {
    "black": "0", "white": "255", "height": "p_partkey % 500 + 1", "width": "p_size", "encoder": "p_partkey % 3", "software": "p_partkey % 60000", "high_pass": "case p_partkey % 2 when 1 then 9 else 8 end", "low_pass": "case p_partkey % 2 when 1 then 7 else 6 end",
    "n_blocks": "2", "n_block_bytes": f"2 * (16 + {_FF})", "n_comments": "1", "n_nist_comments": "case when p_partkey % 3 < 2 then 1 else 0 end", "ppi": "case p_partkey % 3 when 0 then 250 else 500 end",
}
_SCALED = "floor({v} * 10.0::double ** {s} + 0.5) / 10.0::double ** {s}"
_STEP = "case when {v} * 100000 < 65535 then 5 when {v} * 10000 < 65535 then 4 else 3 end"
ORACLES = {
    "c10_differences": """with b as (select p_partkey as path, i, case when i < 16 then substr(md5(p_partkey::varchar), 2 * i + 1, 2) else '' end as e, case when i >= 16 then ['ab', 'cd'][i - 15] when i = p_partkey * 3 % 16 then '00' when i = p_partkey % 16 then 'ff' else substr(md5(p_partkey::varchar), 2 * i + 1, 2) end as a from part, range(18) r(i) where i < 16 or p_partkey % 5 = 0),
d as (select *, i - row_number() over (partition by path order by i) as g from b where e <> a)
select path, min(i) as byte_offset, count(*) as length, string_agg(e, '' order by i) as expected, string_agg(a, '' order by i) as actual from d group by path, g""",
    "s3_inspect": "select p_partkey as path, case p_partkey % 7 when 0 then 'start' when 1 then 'order' when 2 then 'table' when 3 then 'data' when 4 then 'quantization' end as error, "
    + ", ".join(f"case when {_GOOD} then cast({v} as bigint) else -1 end as {k}" for k, v in _VALUES.items())
    + f", case when {_GOOD} then (p_partkey % 1000) / 10.0::double end as shift, case when {_GOOD} then p_size / 100.0::double end as scale, case when {_GOOD} then 0.44::double end as bin_center, case when {_GOOD} then '0,1' end as table_ids from part",
    # Segments in order: start, comment, transform, quantization, Huffman, frame, two blocks, end.
    "w2_segments": "with m as (select p_partkey as path, unnest(case p_partkey % 7 when 0 then [0] when 1 then [65440, 65448, 65444, 65445, 65446, 65443] when 2 then [65440, 65448, 65444, 65445, 65446, 65442, 65443] when 3 then [65440, 65448, 65444, 65445, 65446, 65442, 65443, 65443] when 4 then [65440, 65448, 65444, 65446, 65442, 65443, 65443, 65441] else [65440, 65448, 65444, 65445, 65446, 65442, 65443, 65443, 65441] end) as marker, unnest(range(case p_partkey % 7 when 0 then 1 when 1 then 6 when 2 then 7 when 3 then 8 when 4 then 8 else 9 end)) as segment, p_partkey % 7 as kind from part) select path, cast(segment as bigint) as segment, cast(marker as bigint) as marker, case when kind = 0 then 'start' when kind = 1 and segment = 5 then 'order' when kind = 2 and segment = 6 then 'table' when kind = 3 and segment = 7 then 'data' end as error from m",
    "w6_filters": "with f as (select p_partkey as path, p_size, p_partkey % 2 = 1 as odd, x.filter, x.high, case when p_partkey % 2 = 1 then x.odd_n else x.even_n end as n from part, (values ('high', true, 9, 8), ('low', false, 7, 6)) x(filter, high, odd_n, even_n) where p_partkey % 7 > 0), j as (select *, unnest(range(n)) as j from f), i as (select *, case when odd then abs(j - n // 2) when j >= n // 2 then j - n // 2 else n // 2 - 1 - j end as i, not odd and (not high or j < n // 2) as negative from j) select path, filter, j, round(case when negative then -1 else 1 end * (p_size + i) / 100.0::double, 6) as tap from i",
    "w7_bins": "with v as (select p_partkey as path, i, (p_size + i) / 8.0::double as q, (p_size + i) / 8.0::double * 1.2::double as z from part, range(64) r(i) where p_partkey % 7 not in (0, 4)) select path, i, " + ", ".join(f"round({_SCALED.format(v=v, s='(' + _STEP.format(v=v) + ')')}, 6) as {v}" for v in "qz") + " from v",
    "w9_codes": "with t as (select p_partkey as path, t as table_id, 1 + p_partkey % 2 as two, p_partkey % 4 as five from part, range(2) r(t) where p_partkey % 7 > 0), c as (select *, unnest(range(two + 2 + five)) as p from t) select path, table_id, 10 + p as value, cast(case when p < two then 2 when p < two + 2 then 3 else 5 end as bigint) as length, case when p < two then p when p < two + 2 then 2 * two + p - two else 4 * (2 * two + 2) + p - two - 2 end as code from c",
    "w13_blocks": "select p_partkey as image_id, cast(case when s < 19 then 0 when s < 52 then 1 else 2 end as bigint) as block, cast(sum(case when (p_partkey + s) % 5 = 0 then 0 else (p_size + s) * (p_partkey % 9 + 1) end) as bigint) as n from part, range(60) r(s) group by all",
}
