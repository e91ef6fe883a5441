"""Queries of file formats and streams over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nist
from ..operators import reports
from ..operators.tiles import spread
from ..sources import files, forests
from ..streaming.files import measure_windows

#: Made rows that cost as much as taking a side file apart.
SIDE_FILE_COST = 64


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def s8_gray_map(spark, sf_dir):
    """Gray maps of 4 x 4 pixels, some with comments, a wrong depth or a pixel too few."""
    key = F.col("p_partkey")
    head = F.when(key % 4 == 0, "P5\n4 4\n255\n").when(key % 4 == 1, "P5 # of a part\n4\t4 255 ").when(key % 4 == 2, "P5 4 4 15\n").otherwise("P5 4 5 255\n")
    found = files.gray_map(F.concat(F.encode(head, "ISO-8859-1"), F.unhex(F.md5(key.cast("string").cast("binary")))))
    return _table(spark, sf_dir, "part").select("p_partkey", F.coalesce(found["width"], F.lit(0)).cast("long").alias("width"), F.lower(F.hex(found["pixels"])).alias("pixels"))


def s9_report_cells(spark, sf_dir):
    key = F.col("p_partkey")
    line = F.concat(F.lit('  "'), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit('","say ""'), F.col("p_brand"), F.lit('""",'), F.when(key % 3 == 0, "na").otherwise(F.col("p_size").cast("string")), F.lit(",,NA "))
    cells = files.report_cells(line)
    return _table(spark, sf_dir, "part").select("p_partkey", *(F.get(cells, i).alias(f"c{i}") for i in range(5)), F.size(cells).cast("long").alias("n"))


def s10_report_line(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.concat(F.col("p_brand"), F.when(key % 3 == 0, ', "x"').otherwise(""))
    return _table(spark, sf_dir, "part").select("p_partkey", files.report_line([name, files.number_text(F.when(key % 5 == 0, None).otherwise(key / 8)), F.when(key % 2 == 0, F.col("p_size")), F.col("p_type")]).alias("line"))


def s11_model(spark, sf_dir):
    key = F.col("p_partkey")
    text = F.concat(F.lit("Name = m"), key.cast("string"), F.lit("\nbad line\n\nPath="), F.when(key % 2 == 0, "/abs").otherwise("sub"), F.lit("/a=b\n"), F.when(key % 3 != 0, F.concat(F.lit("Hash = "), F.col("p_brand"))).otherwise("Hash ="))
    found = files.model_info(text, F.lit("/models"))
    return _table(spark, sf_dir, "part").select("p_partkey", *(found[c].alias(c) for c in ("name", "path", "hash")))


def s16_json(spark, sf_dir):
    tagged = lambda tag, value: F.struct(F.lit(tag).alias("tag"), value.alias("value"))
    record = F.struct(F.lit(1).alias("type"), F.array(tagged("1.001", F.lit("0")), tagged("1.002", F.lit("0500")), tagged("1.004", F.col("o_orderpriority"))).alias("fields"))
    data = files.file_from_json(F.to_json(F.struct(F.array(record, record).alias("records"))))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.octet_length(data).cast("long").alias("n_bytes"), F.hex(F.substring(data, 1, 9)).alias("head"))


def s17_side_file(spark, sf_dir):
    key = F.col("p_partkey")
    text = F.concat(F.lit("NIST_COM 7\nPIX_WIDTH "), (key % 800).cast("string"), F.lit("\nPIX_HEIGHT "), F.col("p_size").cast("string"), F.lit("\nPIX_DEPTH 8\nPPI -1\nLOSSY 0\n"))
    part = spread(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", SIDE_FILE_COST)
    return files.side_files(part.select(key.alias("path"), text.cast("binary").alias("content"))).select("path", *(F.col(c).cast("long") for c in ("width", "height", "depth", "ppi")))


def s19_measure_text(spark, sf_dir):
    key = F.col("p_partkey")
    text = F.concat(F.lit("UniformImage: "), (key % 90 / 4).cast("string"), F.lit("\r\n\r\nMu:"), key.cast("string"), F.lit("\nno value:\nOther: NA\n"))
    found = _table(spark, sf_dir, "part").select("p_partkey", F.inline(files.measure_text(text)))
    return found.select("p_partkey", "name", F.coalesce("value", F.lit(-1.0)).alias("value"))


def c5_assessment(spark, sf_dir):
    """Report rows divided into fixed, actionable, mapped and native columns by name."""
    key = F.col("p_partkey").cast("string")
    rows = _table(spark, sf_dir, "part").select(key.alias("Filename"), (F.col("p_partkey") % 101).cast("string").alias("UnifiedQualityScore"), F.col("p_size").cast("string").alias("UniformImage"), F.when(F.col("p_partkey") % 3 == 0, "7").alias("QB_Mu"), F.col("p_retailprice").cast("string").alias("Mu"))
    return reports.assessments(rows, ["Filename", "UnifiedQualityScore"], ["UniformImage"]).select("Filename", F.col("quality_score").cast("long"), F.map_values("actionable")[0].alias("actionable"), F.size("mapped").cast("long").alias("n_mapped"), F.map_values("native")[0].alias("native"))


def q36_batch(spark, sf_dir):
    """Paths of a batch: blank ones go, others become absolute."""
    key = F.col("p_partkey")
    path = F.when(key % 4 == 0, "  ").when(key % 4 == 1, F.concat(F.lit("/in/"), key.cast("string"))).otherwise(F.concat(key.cast("string"), F.lit(".png ")))
    return reports.batch_paths(_table(spark, sf_dir, "part").select(path.alias("path")), "/work")


def c8_sizes(spark, sf_dir):
    key = F.col("p_partkey")
    one = _table(spark, sf_dir, "part").select(key.alias("file"), (10_000 + key % 7).alias("size"), F.lit("h").alias("header"))
    other = one.select("file", (F.col("size") + F.col("file") % 60).alias("size"), F.when(F.col("file") % 13 == 0, "g").otherwise("h").alias("header"))
    return reports.size_tolerance(one, other)


def st_event_windows(spark, sf_dir):
    """Windows of event measures; the same plan runs on a stream."""
    found = measure_windows(_table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("name"), "value"), "1 hour")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "name", "n", F.round("mean", 6).alias("mean"), "low", "high")


def n24_preview_classes(spark, sf_dir):
    """Binary-like fields by control characters and by image tags."""
    key = F.col("o_orderkey")
    value = F.concat(F.col("o_orderpriority"), F.get(F.array(*(F.lit(c) for c in ("\t", "\n", "\x1e", "\x1f", "\x01", "\x1c", "\x1d", ""))), (key % 8).cast("int")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", nist.is_binary_like(value, nist.image_field(key % 17, F.lit(999), value)).alias("binary_like"))


def _forest_text() -> Column:
    """Two trees per supplier: a split with two leaves, and one whose right child is split again over two lines; every seventh file states three."""
    key = F.col("s_suppkey")
    number = lambda c: c.cast("string")
    node = lambda depth, label, *split: [f"            -\n              depth:{depth}\n              norm_class_idx:{label}\n              splits:\n", *split] if split else [f"            -\n              depth:{depth}\n              norm_class_idx:{label}\n"]
    parts = ["%YAML:1.0\nheader: 1\nmy_random_trees:\n   ntrees:", F.when(key % 7 == 0, "3").otherwise("2"), "\n   trees:\n      -\n         nodes:\n"]
    parts += node(0, 1, "                 - { var:", number(key % 69), ", quality:0.5, le:", number(key / 8), " }\n") + node(1, 0) + ["\n"] + node(1, 1)
    parts += ["      -\n         nodes:\n"] + node(0, 0, "                 - { var:3, quality:1.0,\n                    le:-1.5e-2 }\n") + node(1, 1) + node(1, 0, "                 - { var:4, le:", number(key), " }\n") + node(2, 0) + node(2, 1)
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def s12_forest(spark, sf_dir):
    """Nodes of model texts."""
    texts = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("path"), _forest_text().alias("content"))
    found = forests.forest_nodes(texts)
    return found.select("path", *(F.col(c).cast("long") for c in ("tree", "node", "depth", "class")), F.coalesce("feature", F.lit(-1)).cast("long").alias("feature"), F.coalesce("threshold", F.lit(0.0)).alias("threshold"), *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("left", "right")), "error")


QUERIES = {f.__name__: f for f in (s12_forest, s8_gray_map, s9_report_cells, s10_report_line, s11_model, s16_json, s17_side_file, s19_measure_text, c5_assessment, q36_batch, c8_sizes, st_event_windows, n24_preview_classes)}

ORACLES = {
    "s12_forest": "select s_suppkey as path, tree, node, depth, label as class, case when feature = -2 then s_suppkey % 69 else feature end as feature, case when threshold = -8 then s_suppkey / 8.0::double when threshold = -9 then s_suppkey::double else threshold::double end as threshold, l as \"left\", r as \"right\", case when s_suppkey % 7 = 0 then 'count' end as error from supplier, (values (0::bigint, 0::bigint, 0::bigint, 1::bigint, -2::bigint, -8.0, 1::bigint, 2::bigint), (0, 1, 1, 0, -1, 0, -1, -1), (0, 2, 1, 1, -1, 0, -1, -1), (1, 0, 0, 0, 3, -0.015, 1, 2), (1, 1, 1, 1, -1, 0, -1, -1), (1, 2, 1, 0, 4, -9, 3, 4), (1, 3, 2, 0, -1, 0, -1, -1), (1, 4, 2, 1, -1, 0, -1, -1)) t(tree, node, depth, label, feature, threshold, l, r)",
    "s8_gray_map": "select p_partkey, case when p_partkey % 4 < 2 then 4 else 0 end::bigint as width, case when p_partkey % 4 < 2 then md5(p_partkey::varchar) end as pixels from part",
    "s9_report_cells": "select p_partkey, replace(p_name, ' ', ', ') as c0, 'say \"' || p_brand || '\"' as c1, case when p_partkey % 3 <> 0 then p_size::varchar end as c2, '' as c3, null::varchar as c4, 5::bigint as n from part",
    "s10_report_line": "select p_partkey, case when p_partkey % 3 = 0 then '\"' || p_brand || ', \"\"x\"\"\"' else p_brand end || ',' || case when p_partkey % 5 = 0 then 'NA' else regexp_replace((p_partkey / 8.0::double)::varchar, '[.]0$', '') end || ',' || case when p_partkey % 2 = 0 then p_size::varchar else 'NA' end || ',' || p_type as line from part",
    "s11_model": "select p_partkey, case when p_partkey % 3 <> 0 then 'm' || p_partkey end as name, case when p_partkey % 3 <> 0 then case when p_partkey % 2 = 0 then '/abs/a=b' else '/models/sub/a=b' end end as path, case when p_partkey % 3 <> 0 then p_brand end as hash from part",
    "s16_json": "select o_orderkey, 2 * (27 + length(o_orderpriority))::bigint as n_bytes, hex('1.001:' || (27 + length(o_orderpriority))) || '1D' as head from orders",
    "s17_side_file": "select p_partkey as path, p_partkey % 800 as width, p_size::bigint as height, 8::bigint as depth, -1::bigint as ppi from part",
    "s19_measure_text": "select p_partkey, 'UniformImage' as name, p_partkey % 90 / 4.0::double as value from part union all select p_partkey, 'Mu', p_partkey::double from part union all select p_partkey, 'Other', -1 from part",
    "c5_assessment": "select p_partkey::varchar as \"Filename\", p_partkey % 101 as quality_score, p_size::double as actionable, 1::bigint as n_mapped, p_retailprice as native from part",
    "q36_batch": "select case p_partkey % 4 when 1 then '/in/' || p_partkey else '/work/' || p_partkey || '.png' end as path from part where p_partkey % 4 <> 0",
    "c8_sizes": "select p_partkey as file, p_partkey % 60 <= 0.004 * (10000 + p_partkey % 7) and p_partkey % 13 <> 0 as within from part",
    "st_event_windows": "select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type as name, count(value) as n, round(avg(value), 6) as mean, min(value) as low, max(value) as high from events group by 1, 2",
    "n24_preview_classes": "select o_orderkey, o_orderkey % 8 in (4, 5, 6) or o_orderkey % 17 in (10, 13, 14, 15, 16) as binary_like from orders",
}
