"""Queries of raster, minutia and measure operators over the driver's tables, with their SQL.

Rasters are made by rule from ``supplier``, minutiae from ``events``, measures
from ``part`` and ``lineitem``. Each SQL is written from the base columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures
from ..operators import minutiae, pixels, reports, subbands
from ..operators.tiles import spread

WIDTH, HEIGHT = 100, 104


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _raster(spark, sf_dir: str) -> DataFrame:
    """A raster per supplier with a white border of 0 to 4 pixels."""
    key, x, y = F.col("image_id"), F.col("x"), F.col("y")
    each = spread(_table(spark, sf_dir, "supplier"), "s_suppkey", WIDTH * HEIGHT).select(F.col("s_suppkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))))
    border = (key % 5).cast("int")
    white = (x < border) | (y < border) | (x >= WIDTH - border) | (y >= HEIGHT - border)
    return each.select("image_id", "x", "y", F.when(white, 255).otherwise((key * 31 + x * 7 + y * 13 + F.floor(x * y / 5)) % 256).cast("int").alias("v"))


_R = f"""with r as (select image_id, x, y, case when x < b or y < b or x >= {WIDTH} - b or y >= {HEIGHT} - b then 255 else (image_id * 31 + x * 7 + y * 13 + (x * y) // 5) % 256 end::bigint as v
 from (select s_suppkey as image_id, s_suppkey % 5 as b from supplier), range({WIDTH}) a(x), range({HEIGHT}) c(y))"""


def q3_crop(spark, sf_dir):
    found = pixels.crop_bounds(_raster(spark, sf_dir))
    return found.select("image_id", *(F.col(c).cast("long") for c in ("left", "top", "right", "bottom")), F.size("errors").cast("long").alias("n_errors"))


def q4_pad(spark, sf_dir):
    return pixels.pad(pixels.crop(_raster(spark, sf_dir)), 101).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"), F.sum(F.col("v").cast("long") * (F.col("x") + 128 * F.col("y"))).alias("placed"))


def q14_mu(spark, sf_dir):
    return pixels.mu(_raster(spark, sf_dir)).select("image_id", *(F.round(c, 6).alias(c) for c in ("mean", "mmb", "sigma")))


def w18_raster(spark, sf_dir):
    c = pixels.normalize(_raster(spark, sf_dir))
    return c.groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.min("c"), 6).alias("low"), F.round(F.max("c"), 6).alias("high"), F.round(F.sum(F.col("c") * F.col("x")), 2).alias("placed"))


def q18_segmentation(spark, sf_dir):
    return pixels.segmentation(_raster(spark, sf_dir)).select("image_id", F.col("bx").cast("long"), F.col("by").cast("long"), F.round("sd", 6).alias("sd"), "foreground")


def q17_certainty(spark, sf_dir):
    return pixels.orientation_certainty(_raster(spark, sf_dir)).select("image_id", F.col("bx").cast("long"), F.col("by").cast("long"), F.round("ocl", 6).alias("ocl"))


def q19_orientation(spark, sf_dir):
    found = pixels.ridge_orientation(_raster(spark, sf_dir))
    return found.select("image_id", F.col("bx").cast("long"), F.col("by").cast("long"), F.round(F.cos(2 * F.col("theta")), 6).alias("cosine"), F.round(F.sin(2 * F.col("theta")), 6).alias("sine"))


def q20_flow(spark, sf_dir):
    """Flow over a grid of angles made by rule from ``lineitem``: 10 x 10 blocks per supplier."""
    grid = _angles(spark, sf_dir)
    fore = grid.select("image_id", "bx", "by", ((F.col("bx") * 3 + F.col("by") + F.col("image_id")) % 17 != 0).alias("foreground"))
    return pixels.flow_measures(pixels.orientation_flow(grid), fore).select("image_id", F.col("bx").cast("long"), F.col("by").cast("long"), F.round("value", 6).alias("value"))


def _angles(spark, sf_dir):
    cells = spread(_table(spark, sf_dir, "supplier"), "s_suppkey", 900).select(F.col("s_suppkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bx")).withColumn("by", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return cells.withColumn("theta", ((F.col("bx") * 7 + F.col("by") * F.col("by") * 3 + F.col("image_id")) % 31) / 10.0 - 1.5)


def q22_ridges(spark, sf_dir):
    return pixels.ridge_valleys(_raster(spark, sf_dir)).select("image_id", F.col("x").cast("long"), F.round("mean", 6).alias("mean"), F.round("trend", 3).alias("trend"), "ridge")


def q15_otsu(spark, sf_dir):
    return pixels.otsu(_raster(spark, sf_dir)).select("image_id", F.col("threshold").cast("long"))


def n28_bits(spark, sf_dir):
    images = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.lit(12).alias("width"), F.lit(8).alias("height"), F.unhex(F.md5(F.col("p_partkey").cast("string").cast("binary"))).alias("bits"))
    return pixels.unpack_bits(images).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("v") == 255, F.col("x") + 12 * F.col("y"))).cast("long").alias("placed"))


def s7_raster(spark, sf_dir):
    images = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.lit(4).alias("width"), F.when(F.col("p_partkey") % 7 == 0, 5).otherwise(4).alias("height"), F.unhex(F.md5(F.col("p_partkey").cast("string").cast("binary"))).alias("pixels"))
    return pixels.from_bytes(images).select("image_id", F.col("x").cast("long"), F.col("y").cast("long"), F.col("v").cast("long"))


def w20_subbands(spark, sf_dir):
    """Variances of a 4 x 2 grid of subbands, with the window rule."""
    raster = _raster(spark, sf_dir).select("image_id", "x", "y", ((F.col("v") - 128) * (1 + F.col("image_id") % 3)).cast("double").alias("c"))
    nodes = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("subband")).select("image_id", "subband", (F.col("subband") % 4 * 25).alias("x"), (F.floor(F.col("subband") / 4) * 52).alias("y"), F.lit(25).alias("width"), F.lit(52).alias("height"))
    return subbands.subband_variances(raster, nodes).select("image_id", F.col("subband").cast("long"), "cropped", F.round("variance", 5).alias("variance"))


def _minutiae(spark, sf_dir):
    e = F.col("event_id")
    return _table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("image_id"), (e * 37 % 100).cast("int").alias("x"), (e * 53 % 104).cast("int").alias("y"), (e * 11 % 256).cast("int").alias("angle"), (F.floor(F.abs("value")) % 201).cast("int").alias("confidence"), (e % 4).cast("int").alias("type"))


_M = "with m as (select user_id % 50 as image_id, event_id * 37 % 100 as x, event_id * 53 % 104 as y, event_id * 11 % 256 as angle, floor(abs(value))::bigint % 201 as confidence, event_id % 4 as type from events)"


def q11_top(spark, sf_dir):
    return minutiae.top_minutiae(_minutiae(spark, sf_dir), 20).select("image_id", *(F.col(c).cast("long") for c in ("x", "y", "angle", "confidence", "rank")))


def q12_final(spark, sf_dir):
    found = minutiae.final_minutiae(_minutiae(spark, sf_dir), 500, 3, 7)
    return found.groupBy("image_id", "x", "y", "angle", "quality", "type").agg(F.count("*").alias("n")).select("image_id", *(F.col(c).cast("long") for c in ("x", "y", "angle", "quality", "type", "n")))


def q27_counts(spark, sf_dir):
    images = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(120).alias("width"), F.lit(110).alias("height"))
    wide = _minutiae(spark, sf_dir).withColumn("x", F.col("x") * 4).withColumn("y", F.col("y") * 4)
    return minutiae.minutia_counts(wide, images)


def q28_mean_quality(spark, sf_dir):
    return minutiae.mean_quality(_minutiae(spark, sf_dir), _raster(spark, sf_dir)).select("image_id", F.round("share", 6).alias("share"))


def q26_features(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("image_id"), (F.col("l_discount") * 10).alias("v"))
    found = reports.histogram_features(lines, "v", measures.BOUNDS["OCL"], "OCL_Bin10_")
    return found.select("image_id", *(F.col(f"OCL_Bin10_{i}") for i in range(10)), F.round("OCL_Bin10_Mean", 6).alias("OCL_Bin10_Mean"), F.round("OCL_Bin10_StdDev", 6).alias("OCL_Bin10_StdDev"))


def _named(spark, sf_dir):
    names = ["Mu", "FingerJetFX_MinutiaeCount", "OCL_Bin10_Mean", "OrientationMap_ROIFilter_CoherenceSum", "OF_Bin10_Mean", "RVUP_Bin10_Mean", "Other"]
    key = F.col("p_partkey")
    value = lambda i: F.when(key % 97 == i, None).otherwise((key * (i + 3) % 1000) / 1000.0 * F.lit([255.0, 150.0, 1.0, 3150.0, 1.0, 3.0, 1.0][i]))
    return _table(spark, sf_dir, "part").select(key.alias("image_id"), F.inline(F.array(*(F.struct(F.lit(n).alias("name"), value(i).alias("value")) for i, n in enumerate(names)))))


_NAMED = "with v as (select p_partkey as image_id, i, name, case when p_partkey % 97 = i then null else (p_partkey * (i + 3) % 1000) / 1000.0::double * top end as value from part, (values (0, 'Mu', 255.0::double), (1, 'FingerJetFX_MinutiaeCount', 150.0), (2, 'OCL_Bin10_Mean', 1.0), (3, 'OrientationMap_ROIFilter_CoherenceSum', 3150.0), (4, 'OF_Bin10_Mean', 1.0), (5, 'RVUP_Bin10_Mean', 3.0), (6, 'Other', 1.0)) n(i, name, top))"


def q32_blocks(spark, sf_dir):
    return _named(spark, sf_dir).select("image_id", "name", F.coalesce(measures.quality_block(F.col("name"), F.col("value")), F.lit(-1)).cast("long").alias("block"))


def q38_shown(spark, sf_dir):
    found = _named(spark, sf_dir).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    return found.select("image_id", F.array_join(F.transform(measures.shown(F.col("m"), 3), lambda e: F.concat_ws("=", e["label"], e["value"])), ";").alias("shown"))


def q33_feedback(spark, sf_dir):
    key = F.col("p_partkey")
    found = measures.feedback(key % 7, key % 11, key % 13, key % 17)
    return _table(spark, sf_dir, "part").select(key.alias("image_id"), F.explode(found).alias("name", "value"))


def q29_vector(spark, sf_dir):
    """Measures of two modules as one row per image; the later module wins."""
    first = _named(spark, sf_dir).withColumn("module", F.lit(1))
    second = first.where("name in ('Mu', 'Other')").select("image_id", "name", (F.col("value") + 1).alias("value"), F.lit(2).alias("module"))
    return reports.feature_vectors(first.union(second), ["Mu", "OCL_Bin10_Mean", "Other"]).select("image_id", *(F.round(c, 6).alias(c) for c in ("Mu", "OCL_Bin10_Mean", "Other")), F.col("missing").cast("long"))


def _validated(spark, sf_dir):
    key = F.col("p_partkey")
    width, height = (key % 9 - 1).cast("int"), (key % 5).cast("int")
    return _table(spark, sf_dir, "part"), key, width, height


def q1_errors(spark, sf_dir):
    part, key, width, height = _validated(spark, sf_dir)
    found = measures.raster_errors(width, height, F.when(key % 3 == 0, 16).otherwise(8), F.when(key % 4 == 0, 1000).otherwise(500), width * F.greatest(height, F.lit(1)))
    return part.select("p_partkey", F.array_join(found.cast("array<string>"), ",").alias("codes"))


def w1_errors(spark, sf_dir):
    part, key, width, height = _validated(spark, sf_dir)
    found = measures.encode_errors(width, height, F.lit(8), (key % 6 - 1).cast("double"), (key % 300).cast("int"), F.when(key % 2 == 0, (key * 40 % 70000).cast("int")), width * 2)
    return part.select("p_partkey", F.array_join(found.cast("array<string>"), ",").alias("codes"))


def c11_messages(spark, sf_dir):
    part, key, *_ = _validated(spark, sf_dir)
    texts = F.slice(F.array(F.col("p_name"), F.col("p_brand"), F.col("p_type")), 1, (key % 4).cast("int"))
    return part.select("p_partkey", measures.message("Image", texts).alias("message"))


def c12_links(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", measures.documentation("docs/errors#", F.col("p_brand")).alias("uri"))


def w8_scaled(spark, sf_dir):
    found = measures.scaled(F.col("p_retailprice") * F.when(F.col("p_partkey") % 5 == 0, 0.0).when(F.col("p_partkey") % 5 == 1, 1000.0).otherwise(0.001))
    return _table(spark, sf_dir, "part").select("p_partkey", *(F.coalesce(found[c], F.lit(-1)).cast("long").alias(c) for c in ("raw", "scale")))


def w28_comment(spark, sf_dir):
    key = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(key, measures.comment(key % 900, F.col("p_size"), F.lit(8), F.when(key % 2 == 0, 500).otherwise(0), (key % 9) / 4.0).alias("comment"))


def c7_mismatch(spark, sf_dir):
    letters = lambda c: F.split(c, "")
    other = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.concat("p_type", F.lit("+"))).otherwise(F.translate("p_type", "EA", "ea"))
    return _table(spark, sf_dir, "part").select("p_partkey", measures.first_mismatch(letters(F.col("p_type")), letters(other)).cast("long").alias("at"))


def _report(spark, sf_dir, prefix: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.select(F.concat(F.lit(prefix), F.col("p_partkey").cast("string")).alias("Filename"), F.col("p_size").cast("string").alias("size"), (F.col("p_partkey") % 7).cast("string").alias("score"), "p_partkey")


def c3_differences(spark, sf_dir):
    """The same report under another folder, with rows missing and added and cells changed."""
    key = F.col("p_partkey")
    expected = _report(spark, sf_dir, "a/")
    actual = expected.where(key % 101 != 0).withColumn("score", F.when(key % 17 == 0, None).otherwise(F.col("score")))
    actual = actual.union(_report(spark, sf_dir, "b\\new").where(key % 499 == 0))
    return reports.compare(expected.drop("p_partkey"), actual.drop("p_partkey"), ["Filename", "size", "score"])


def c4_summary(spark, sf_dir):
    expected = _report(spark, sf_dir, "a/").drop("p_partkey")
    found = reports.compare(expected, expected.withColumn("size", F.when(F.col("size") == "7", "x").otherwise(F.col("size"))), ["Filename", "size", "score"])
    return reports.summary(found, expected, ["Filename", "size", "score"])


def c6_classes(spark, sf_dir):
    key = F.col("p_partkey")
    flags = _table(spark, sf_dir, "part").select(key.cast("string").alias("file"), F.when(key % 2 == 0, 0.75).otherwise(2.25).alias("rate"), (key % 3 != 0).alias("first"), (key % 5 != 0).alias("second"))
    return reports.classes(flags)


def c9_tolerances(spark, sf_dir):
    one = _named(spark, sf_dir)
    other = one.withColumn("value", F.col("value") + (F.col("image_id") % 40) / 1000.0)
    return reports.beyond_tolerance(one, other).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("apart"), 4).alias("apart"))


def q30_forest(spark, sf_dir):
    """A forest of 40 trees of depth 3, scored from its node table."""
    leaf = lambda c: {"class": c}
    split = lambda f, t, a, b: {"feature": f, "threshold": t, "left": a, "right": b}
    trees = [split("size", 3.5 + i, split("price", 900.0 + 20 * i, leaf(0), split("size", 1.5, leaf(1), leaf(0))), split("price", 1400.0 - 10 * i, leaf(1), leaf(0))) for i in range(40)]
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.col("p_size").cast("double").alias("size"), F.floor("p_retailprice").cast("double").alias("price"))
    return reports.forest_scores(rows, trees)


def q31_digests(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    stated = F.when(F.col("doc_id") % 3 == 0, F.upper(F.md5(text.cast("binary")))).when(F.col("doc_id") % 3 == 1, F.md5(F.lit("x").cast("binary")))
    return _table(spark, sf_dir, "documents").select("doc_id", (F.lower(stated) == F.md5(text.cast("binary"))).alias("right"))


QUERIES = {f.__name__: f for f in (q3_crop, q4_pad, q14_mu, w18_raster, q18_segmentation, q17_certainty, q19_orientation, q20_flow, q22_ridges, q15_otsu, n28_bits, s7_raster, w20_subbands, q11_top, q12_final, q27_counts, q28_mean_quality, q26_features, q32_blocks, q38_shown, q33_feedback, q29_vector, q1_errors, w1_errors, c11_messages, c12_links, w8_scaled, w28_comment, c7_mismatch, c3_differences, c4_summary, c6_classes, c9_tolerances, q30_forest, q31_digests)}

_G = f"""{_R}, o as (select image_id, x - OFF as x, y - OFF as y, v from r where x >= OFF and y >= OFF),
g as (select image_id, x // 32 as bx, y // 32 as "by", lag(v) over p as l, lead(v) over p as n, lag(v) over q as u, lead(v) over q as d, v from o window p as (partition by image_id, x // 32, y order by x), q as (partition by image_id, y // 32, x order by y)),
s as (select image_id, bx, "by", case when l is null then n - v when n is null then v - l else (n - l) / 2.0::double end as gx, case when u is null then d - v when d is null then v - u else (d - u) / 2.0::double end as gy from g),
b as (select image_id, bx, "by", avg(gx * gx) as a, avg(gy * gy) as b, avg(gx * gy) as c from s group by all having count(*) = 1024)"""
_BOUND = ", ".join(map(repr, measures.BOUNDS["OCL"]))
_BINS = ", ".join(f'count(*) filter (where b = {i}) as "OCL_Bin10_{i}"' for i in range(10))

ORACLES = {
    "q3_crop": f"{_R}, c as (select image_id, x, avg(v) as m from r group by all), l as (select image_id, y, avg(v) as m from r group by all) select image_id, \"left\", top, \"right\", bottom, 0::bigint as n_errors from (select image_id, min(x) as \"left\", max(x) as \"right\" from c where m <= 250 group by 1) join (select image_id, min(y) as top, max(y) as bottom from l where m <= 250 group by 1) using (image_id)",
    "q4_pad": f"{_R}, k as (select image_id, {WIDTH} - 2 * (image_id % 5) as w, {HEIGHT} - 2 * (image_id % 5) as h, image_id % 5 as b from (select distinct image_id from r)), p as (select k.image_id, x, y, case when x < w and y < h then (k.image_id * 31 + (x + b) * 7 + (y + b) * 13 + ((x + b) * (y + b)) // 5) % 256 else 255 end as v from k, range(128) a(x), range(128) c(y) where x < greatest(w, 101) and y < greatest(h, 101)) select image_id, count(*) as n, sum(v)::bigint as total, sum(v * (x + 128 * y))::bigint as placed from p group by 1",
    "q14_mu": f"{_R}, b as (select image_id, avg(v) as m from r group by image_id, x // 32, y // 32) select image_id, round(avg(v), 6) as mean, any_value(mmb) as mmb, round(stddev_pop(v), 6) as sigma from r join (select image_id, round(avg(m), 6) as mmb from b group by 1) using (image_id) group by 1",
    "w18_raster": f"{_R}, s as (select image_id, avg(v) as m, greatest(avg(v) - min(v), max(v) - avg(v)) / 128 as k from r group by 1), c as (select image_id, x, (v - m) / k as c from r join s using (image_id)) select image_id, count(*) as n, round(min(c), 6) as low, round(max(c), 6) as high, round(sum(c * x), 2) as placed from c group by 1",
    "q18_segmentation": f"{_R}, s as (select image_id, stddev_pop(v) as k from r group by 1), b as (select image_id, x // 32 as bx, y // 32 as \"by\", stddev_pop(v) as o from r group by all) select image_id, bx, \"by\", round(o / k, 6) as sd, o / k > 0.1 as foreground from b join s using (image_id)",
    "q17_certainty": f"{_G.replace('OFF', '0')} select image_id, bx, \"by\", round(1 - (a + b - sqrt((a - b) ** 2 + 4 * c ** 2)) / (a + b + sqrt((a - b) ** 2 + 4 * c ** 2)), 6) as ocl from b where a + b > 0",
    "q19_orientation": f"{_G.replace('OFF', '2')} select image_id, bx, \"by\", round(cos(atan2(c, a - b)), 6) as cosine, round(sin(atan2(c, a - b)), 6) as sine from b where (bx + 1) * 32 + 4 <= {WIDTH} and (\"by\" + 1) * 32 + 4 <= {HEIGHT}",
    "q20_flow": "with g as (select s_suppkey as i, bx, yy, ((bx * 7 + yy * yy * 3 + s_suppkey) % 31) / 10.0::double - 1.5 as t, (bx * 3 + yy + s_suppkey) % 17 <> 0 as f from supplier, range(10) a(bx), range(10) b(yy)), d as (select * from range(-1, 2) a(dx), range(-1, 2) b(dy)), n as (select g.i, g.bx, g.yy, abs(g.t - coalesce(h.t, 0)) as apart, coalesce(h.f, false) as f from g cross join d left join g h on h.i = g.i and h.bx = g.bx + dx and h.yy = g.yy + dy), w as (select i, bx, yy, sum(least(apart, 2 * pi() - apart)) / 8 as flow, bool_and(f) as f from n group by all) select i as image_id, bx, yy as \"by\", round((flow - radians(4)) / (pi() / 2 - radians(4)), 6) as value from w where f and flow > radians(4)",
    "q22_ridges": f"{_R}, k as (select image_id, x, sum(v)::bigint as s, count(*) as h from r group by all), q as (select image_id, any_value(h) as h, count(*) as n, sum(x + 1)::bigint as sx, sum((x + 1) * (x + 1))::bigint as sxx, sum(s)::bigint as sy, sum((x + 1) * s)::bigint as sxy from k group by 1), l as (select image_id, (n * sxy - sx * sy)::double / ((n * sxx - sx * sx) * h)::double as b, sy::double / h as y, sx, n from q), t as (select image_id, x, s::double / h as mean, (x + 1) * round(b, 10) + round((y - b * sx) / n, 10) as trend from k join l using (image_id)) select image_id, x, round(mean, 6) as mean, round(trend, 3) as trend, mean < trend as ridge from t",
    "q15_otsu": f"{_R}, h as (select image_id, v, count(*) as n from r group by all), c as (select image_id, v, sum(n) over o as w0, sum(n * v) over o as s0, sum(n) over e as n, sum(n * v) over e as s from h window o as (partition by image_id order by v), e as (partition by image_id)), b as (select image_id, v, round(w0::double * (n - w0) * (s0::double / w0 - (s - s0)::double / (n - w0)) ** 2, 6) as b from c where w0 < n) select image_id, v::bigint as threshold from b qualify row_number() over (partition by image_id order by b desc, v) = 1",
    "n28_bits": "with b as (select p_partkey as image_id, x, y, (cast('0x' || substr(md5(p_partkey::varchar), 1 + 2 * (2 * y + x // 8), 2) as integer) >> (7 - x % 8)) & 1 as bit from part, range(12) a(x), range(8) c(y)) select image_id, count(*) as n, sum(case when bit = 1 then x + 12 * y end)::bigint as placed from b group by 1",
    "s7_raster": "select p_partkey as image_id, i % 4 as x, i // 4 as y, cast('0x' || substr(md5(p_partkey::varchar), 1 + 2 * i, 2) as bigint) as v from part, range(16) a(i) where p_partkey % 7 <> 0",
    "w20_subbands": f"{_R}, c as (select image_id, x // 25 + 4 * (y // 52) as k, x % 25 as x, y % 52 as y, ((v - 128) * (1 + image_id % 3))::double as c from r), s as (select image_id, k, var_samp(c) as w, var_samp(c) filter (where x >= 3 and x < 3 + 18 and y >= 14 and y < 14 + 22) as i from c group by all), t as (select image_id, sum(i) filter (where k < 4) >= 20000 as cropped from s group by 1) select image_id, k as subband, cropped, round(case when cropped then i else w end, 5) as variance from s join t using (image_id)",
    "q11_top": f"{_M}, k as (select *, row_number() over (partition by image_id order by confidence desc, y, x, angle) as rank from m) select image_id, x, y, angle, confidence, rank from k where rank <= 20",
    "q12_final": f"{_M}, f as (select image_id, ((x * 635 // 500 + 3 * 635 // 500) * 197 + 83) // 167 as x, ((y * 635 // 500 + 7 * 635 // 500) * 197 + 83) // 167 as y, (320 - angle) % 256 as angle, least((confidence + 1) // 2, 100) as quality, case when type in (1, 2) then type else 0 end as type from m) select image_id, x, y, angle, quality, type, count(*) as n from f group by all",
    "q27_counts": f"{_M}, w as (select image_id, 4 * x as x, 4 * y as y from m), c as (select image_id, sum(x)::bigint // count(*) as cx, sum(y)::bigint // count(*) as cy from w group by 1) select s_suppkey as image_id, count(x) as n, count(*) filter (where x between greatest(0, cx - 100) and least(119, cx + 100) and y between greatest(0, cy - 100) and least(109, cy + 100)) as n_centre from supplier left join w on image_id = s_suppkey left join c using (image_id) group by 1",
    "q28_mean_quality": f"{_R}, {_M[5:]}, k as (select *, row_number() over () as id from m), s as (select image_id, avg(v) as mean, stddev_pop(v) as sd from r group by 1), o as (select k.image_id, id, avg(v) as own from k join r on r.image_id = k.image_id and r.x >= greatest(0, k.x - 16) and r.x < greatest(0, k.x - 16) + 32 and r.y >= greatest(0, k.y - 16) and r.y < greatest(0, k.y - 16) + 32 group by all) select image_id, round(count(*) filter (where (mean - own) / sd > 0 and (mean - own) / sd <= 0.5) / count(*), 6) as share from o join s using (image_id) group by 1",
    "q26_features": f"with v as (select l_partkey as image_id, l_discount * 10 as v, len(list_filter([{_BOUND}]::double[], lambda x: l_discount * 10 >= x)) as b from lineitem) select image_id, {_BINS}, round(avg(v), 6) as \"OCL_Bin10_Mean\", round(stddev_pop(v), 6) as \"OCL_Bin10_StdDev\" from v group by 1",
    "q32_blocks": f"{_NAMED} select image_id, name, cast(coalesce(case i when 0 then floor(101 * (value / 255)) when 1 then floor(least(value, 100)) when 2 then floor(101 * value) when 3 then floor(101 * (value / 3150)) when 4 then floor(101 * ((value + 4 / 86.0::double) / (180 / 86.0::double))) when 5 then floor(100 / (1 + exp((1 - value) / 0.5::double)) + 0.5) end, -1) as bigint) as block from v",
    "q38_shown": f"{_NAMED}, k as (select *, row_number() over (partition by image_id order by name) as n from v where value is not null) select image_id, string_agg(name || '=' || case when value = floor(value) then cast(value::bigint as varchar) when abs(value) >= 10 then printf('%.2f', value + case when (value * 8)::bigint = value * 8 and (value * 8)::bigint % 2 <> 0 then 0.001 else 0 end) else printf('%.3f', value + case when (value * 16)::bigint = value * 16 and (value * 16)::bigint % 2 <> 0 then 0.0001 else 0 end) end, ';' order by name) as shown from k where n <= 3 group by 1",
    "q33_feedback": "select p_partkey as image_id, name, (p_partkey % m)::double as value from part, (values ('UniformImage', 7), ('EmptyImageOrContrastTooLow', 11), ('FingerprintImageWithMinutiae', 13), ('SufficientFingerprintForeground', 17)) n(name, m)",
    "q29_vector": f"{_NAMED} select image_id, round(max(case when i = 0 then value + 1 end), 6) as \"Mu\", round(max(case when i = 2 then value end), 6) as \"OCL_Bin10_Mean\", round(max(case when i = 6 then value + 1 end), 6) as \"Other\", count(*) filter (where i in (0, 2, 6) and value is null) as missing from v group by 1",
    "q1_errors": "with v as (select p_partkey as k, p_partkey % 9 - 1 as w, p_partkey % 5 as h from part) select k as p_partkey, concat_ws(',', case when w <= 0 then 1 end, case when h <= 0 then 2 end, case when k % 3 = 0 then 3 end, case when k % 4 = 0 then 4 end, case when w * greatest(h, 1) <> case when w > 0 and h > 0 then w * h else -1 end then 5 end) as codes from v",
    "w1_errors": "with v as (select p_partkey as k, p_partkey % 9 - 1 as w, p_partkey % 5 as h from part), e as (select *, concat_ws(',', case when w <= 0 then 1 end, case when h <= 0 then 2 end, case when k % 6 <= 1 then 4 end, case when k % 300 > 255 then 5 end, case when k % 2 = 0 and k * 40 % 70000 > 65535 then 6 end) as c from v) select k as p_partkey, case when c = '' and w * 2 <> w * h then '7' else c end as codes from e",
    "c11_messages": "select p_partkey, case p_partkey % 4 when 0 then 'Image validation failed.' when 1 then p_name when 2 then 'Image validation failed with 2 issues:' || chr(10) || '- ' || p_name || chr(10) || '- ' || p_brand else 'Image validation failed with 3 issues:' || chr(10) || '- ' || p_name || chr(10) || '- ' || p_brand || chr(10) || '- ' || p_type end as message from part",
    "c12_links": "select p_partkey, 'docs/errors#' || lower(p_brand) as uri from part",
    "w8_scaled": "with v as (select p_partkey, p_retailprice * case p_partkey % 5 when 0 then 0.0 when 1 then 1000.0 else 0.001 end::double as v from part), s as (select *, case when v > 0 and v < 65535 then (select min(s) from range(41) t(s) where v * 10.0::double ** s >= 65535) - 1 end as s from v) select p_partkey, cast(case when v = 0 then 0 when s is not null then floor(v * 10.0::double ** s + 0.5) else -1 end as bigint) as raw, cast(case when v = 0 then 0 else coalesce(s, -1) end as bigint) as scale from s",
    "w28_comment": "select p_partkey, concat_ws(chr(10), 'NIST_COM 9', 'PIX_WIDTH ' || p_partkey % 900, 'PIX_HEIGHT ' || p_size, 'PIX_DEPTH 8', 'PPI ' || case when p_partkey % 2 = 0 then 500 else -1 end, 'LOSSY 1', 'COLORSPACE GRAY', 'COMPRESSION WSQ', 'WSQ_BITRATE ' || printf('%.6f', (p_partkey % 9) / 4.0::double)) as comment from part",
    "c7_mismatch": "select p_partkey, cast(case p_partkey % 3 when 0 then -1 when 1 then length(p_type) else coalesce(nullif(least(coalesce(nullif(instr(p_type, 'E'), 0), 999), coalesce(nullif(instr(p_type, 'A'), 0), 999)), 999), 0) - 1 end as bigint) as at from part",
    "c3_differences": "with p as (select p_partkey as k, p_partkey::varchar as f, (p_partkey % 7)::varchar as score from part) select '*' as filename, '__metadata__' as \"column\", count(*)::varchar as expected, (count(*) filter (where k % 101 <> 0) + count(*) filter (where k % 499 = 0))::varchar as actual from p having count(*) filter (where k % 101 = 0) <> count(*) filter (where k % 499 = 0) union all select f, 'Filename', f, null from p where k % 101 = 0 union all select f, 'score', score, null from p where k % 101 <> 0 and k % 17 = 0 union all select 'new' || f, 'Filename', null, 'new' || f from p where k % 499 = 0",
    "c4_summary": "select count(*) filter (where p_size = 7) = 0 as conformant, count(*) as n_rows, 3::bigint as n_columns, count(*) filter (where p_size = 7) as n_differences from part",
    "c6_classes": "with v as (select case when p_partkey % 2 = 0 then 0.75 else 2.25 end::double as rate, p_partkey % 3 <> 0 as a, p_partkey % 5 <> 0 as b from part) select rate, count(*) filter (where a and b) as n_both, count(*) filter (where a and not b) as n_first, count(*) filter (where b and not a) as n_second, count(*) filter (where not a and not b) as n_neither from v group by rollup (rate)",
    "c9_tolerances": f"{_NAMED}, d as (select name, abs(value + (image_id % 40) / 1000.0::double - value) as apart, case when name like 'OF_%' or name like 'OCL_%' then 0.02 when name like 'RVUP_%' then 0.1 when name like 'Orient%' then 0.5 else 0.001 end::double as width from v where value is not null) select name, count(*) as n, round(sum(apart), 4) as apart from d where apart > width + 1e-9 group by 1",
    "q30_forest": "with t as (select p_partkey, sum(case when p_size <= 3.5 + i then case when floor(p_retailprice) <= 900 + 20 * i then 0 when p_size <= 1.5 then 1 else 0 end else case when floor(p_retailprice) <= 1400 - 10 * i then 1 else 0 end end) as v from part, range(40) r(i) group by 1) select p_partkey as image_id, v::bigint as votes, cast(floor(v / 40.0::double * 100 + 0.5) as bigint) as score from t",
    "q31_digests": "select doc_id, case doc_id % 3 when 0 then true when 1 then md5(coalesce(text, '')) = md5('x') end as \"right\" from documents",
}
