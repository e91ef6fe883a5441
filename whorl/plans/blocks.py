"""Queries of slanted blocks over wave rasters made by rule from ``supplier``, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import slanted
from ..operators.checkpoints import saved
from ..operators.tiles import spread

WIDTH, HEIGHT = 100, 136


def _raster(spark, sf_dir: str) -> DataFrame:
    """Waves of a direction and width of their own per supplier, with some noise; a white margin at the right."""
    key, x, y = F.col("image_id"), F.col("x"), F.col("y")
    each = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey", WIDTH * HEIGHT).select(F.col("s_suppkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))))
    wave = F.abs((x * (2 + key % 3) + y * (key % 4)) % 26 - 13) * 17
    return each.select("image_id", "x", "y", F.when(x >= WIDTH - key % 5, 255).otherwise(wave + (x * y + key) % 29).cast("int").alias("v"))


_R = f"""r as (select s_suppkey as image_id, x, y, case when x >= {WIDTH} - s_suppkey % 5 then 255 else abs((x * (2 + s_suppkey % 3) + y * (s_suppkey % 4)) % 26 - 13) * 17 + (x * y + s_suppkey) % 29 end::bigint as v from supplier, range({WIDTH}) a(x), range({HEIGHT}) b(y)),
sg as (select image_id, stddev_pop(v) as k from r group by 1), sb as (select image_id, x // 32 as bx, y // 32 as yy, stddev_pop(v) as o from r group by all),
fore as (select image_id, bx, yy from sb join sg using (image_id) where o / k > 0.1),
m as (select image_id, (x - 2) // 32 as bx, (y - 2) // 32 as yy, x, y, v from r where x >= 2 and y >= 2 and x < 2 + {(WIDTH - 4) // 32 * 32} and y < 2 + {(HEIGHT - 4) // 32 * 32}),
g as (select image_id, bx, yy, coalesce((lead(v) over h - lag(v) over h) / 2.0::double, lead(v) over h - v, v - lag(v) over h) as gx, coalesce((lead(v) over w - lag(v) over w) / 2.0::double, lead(v) over w - v, v - lag(v) over w) as gy from m window h as (partition by image_id, y, bx order by x), w as (partition by image_id, x, yy order by y)),
blocks as (select image_id, bx, yy, atan2(avg(gx * gy), avg(gx * gx) - avg(gy * gy)) / 2 as theta from g where (select count(*) from fore f where f.image_id = g.image_id and f.bx in (g.bx, g.bx + 1) and f.yy in (g.yy, g.yy + 1)) = 4 group by all)"""


def _turned_sql(width: int, height: int, border: int, turn: float) -> str:
    side = 36 + 2 * border
    left, top, c = 18 - (width // 2 - 1) - 1, 18 - (height // 2 - 1) - 1, side / 2
    return f"""{_R},
k as (select image_id, bx, yy, cos(theta + {turn!r}) as a, sin(theta + {turn!r}) as b, (1 - cos(theta + {turn!r})) * {c} - sin(theta + {turn!r}) * {c} as e, sin(theta + {turn!r}) * {c} + (1 - cos(theta + {turn!r})) * {c} as f from blocks),
s as (select image_id, bx, yy, x, y, floor((round_even((-b / (a * a + b * b) * (y + {top}) + (-a * e + b * f) / (a * a + b * b)) * 1024, 0) + 512 + round_even(a / (a * a + b * b) * (x + {left}) * 1024, 0)) / 1024)::bigint as sx,
 floor((round_even((a / (a * a + b * b) * (y + {top}) + (-b * e - a * f) / (a * a + b * b)) * 1024, 0) + 512 + round_even(b / (a * a + b * b) * (x + {left}) * 1024, 0)) / 1024)::bigint as sy from k, range({width}) p(x), range({height}) q(y)),
t as (select s.image_id, s.bx, s.yy, s.x, s.y, coalesce(case when sx between 0 and {side - 1} and sy between 0 and {side - 1} then r.v end, 0) as v from s left join r on r.image_id = s.image_id and r.x = bx * 32 + sx - {border} and r.y = yy * 32 + sy - {border})"""


_STRUCTURE = """,
km as (select image_id, bx, yy, x, sum(v)::bigint as s, count(*) as h from t group by all),
kq as (select image_id, bx, yy, any_value(h) as h, count(*) as n, sum(x + 1)::bigint as sx, sum((x + 1) * (x + 1))::bigint as sxx, sum(s)::bigint as sy, sum((x + 1) * s)::bigint as sxy from km group by all),
kl as (select image_id, bx, yy, round((n * sxy - sx * sy)::double / ((n * sxx - sx * sx) * h)::double, 10) as slope, sy::double / h as y0, sx, n from kq),
c as (select image_id, bx, yy, x, (x + 1) * slope + round((y0 - slope * sx) / n, 10) as trend, s::double / h < (x + 1) * slope + round((y0 - slope * sx) / n, 10) as ridge from km join kl using (image_id, bx, yy)),
d as (select image_id, bx, yy, x - 1 as place, before as ended from (select *, lag(ridge) over (partition by image_id, bx, yy order by x) as before from c) where before <> ridge)"""
_CLARITY = """,
w as (select *, place - coalesce(lag(place) over (partition by image_id, bx, yy order by place), 0) as width from d),
u as (select image_id, bx, yy, coalesce(avg(width / 20.0::double) filter (where ended), 0) as rw, coalesce(avg(width / 20.0::double) filter (where not ended), 0) as vw from w group by all),
o as (select image_id, bx, yy, count(*) filter (where ridge and v >= trend) as rb, count(*) filter (where ridge) as rn, count(*) filter (where not ridge and v < trend) as vb, count(*) filter (where not ridge) as vn from t join c using (image_id, bx, yy, x) group by all),
value as (select image_id, bx, yy, case when rw between 3 / 20.0::double and 10 / 20.0::double and vw between 2 / 20.0::double and 10 / 20.0::double and rn > 0 and vn > 0 then 1 - (vb::double / vn + rb::double / rn) / 2 else 0 end as v from o left join u using (image_id, bx, yy))"""


def _blocks(spark, sf_dir):
    raster = _raster(spark, sf_dir)
    return raster, slanted.valid_blocks(raster)


_NAMES = lambda df, *more: df.select("image_id", F.col("bx").cast("long"), F.col("by").cast("long").alias("block_y"), *more)


def q21_blocks(spark, sf_dir):
    """Pixels of the turned blocks."""
    found = slanted.turned_blocks(*_blocks(spark, sf_dir), border=2)
    return _NAMES(found, F.col("x").cast("long"), F.col("y").cast("long"), F.col("v").cast("long"))


def q23_clarity(spark, sf_dir):
    found = slanted.local_clarity(saved(slanted.turned_lines(*_blocks(spark, sf_dir))))
    return _NAMES(found, F.round("value", 6).alias("value"))


def q23_features(spark, sf_dir):
    values = slanted.local_clarity(saved(slanted.turned_lines(*_blocks(spark, sf_dir))))
    found = slanted.block_features(values, slanted.CLARITY_BOUNDS, "LCS_Bin10_")
    return found.select("image_id", *(F.col(f"LCS_Bin10_{i}").cast("long").alias(f"n{i}") for i in range(10)), F.round("LCS_Bin10_Mean", 6).alias("mean"), F.round("LCS_Bin10_StdDev", 6).alias("sd"))


def q24_uniformity(spark, sf_dir):
    found = slanted.uniformity_ratios(saved(slanted.turned_lines(*_blocks(spark, sf_dir), border=2)))
    return _NAMES(found, F.col("turn").cast("long"), F.round("value", 6).alias("value"))


def q25_frequencies(spark, sf_dir):
    turned = slanted.turned_lines(*_blocks(spark, sf_dir), slanted.SHORT, slanted.LONG, 2, math.pi / 2, "x")
    return _NAMES(slanted.frequencies(turned), F.round("value", 6).alias("value"))


def q25_features(spark, sf_dir):
    """Features of the frequencies; images with fewer than ten blocks have the error."""
    turned = slanted.turned_lines(*_blocks(spark, sf_dir), slanted.SHORT, slanted.LONG, 2, math.pi / 2, "x")
    found = slanted.block_features(slanted.frequencies(turned), slanted.FREQUENCY_BOUNDS, "FDA_Bin10_", slanted.FEWEST)
    return found.select("image_id", "error", F.round("FDA_Bin10_Mean", 6).alias("mean"), F.round("FDA_Bin10_StdDev", 6).alias("sd"))


_SPECTRUM = f"""{_turned_sql(16, 32, 2, math.pi / 2)},
am as (select image_id, bx, yy, y, avg(v) as mean from t group by all),
sp as (select image_id, bx, yy, f, round(sqrt(sum(mean * cos(2 * pi() * (f * y % 32) / 32)) ** 2 + sum(mean * sin(2 * pi() * (f * y % 32) / 32)) ** 2), 9) as a from am, range(1, 32) z(f) group by all),
nb as (select *, lag(a) over l as p, lead(a) over l as n, sum(case when f <= 15 then a end) over (partition by image_id, bx, yy) as total from sp window l as (partition by image_id, bx, yy order by f)),
pk as (select * from nb qualify row_number() over (partition by image_id, bx, yy order by a desc, f) = 1),
value as (select image_id, bx, yy, case when p is null or n is null then 1 else (a + 0.3::double * (p + n)) / total end as v from pk)"""
QUERIES = {f.__name__: f for f in (q21_blocks, q23_clarity, q23_features, q24_uniformity, q25_frequencies, q25_features)}
_BINS = lambda bounds: ", ".join(f"count(*) filter (where {' + '.join(f'(v >= {b})::int' for b in bounds)} = {i}) as n{i}" for i in range(len(bounds) + 1))
ORACLES = {
    "q21_blocks": f"with {_turned_sql(32, 16, 2, 0.0)} select image_id, bx, yy as block_y, x, y, v from t",
    "q23_clarity": f"with {_turned_sql(32, 16, 0, 0.0)}{_STRUCTURE}{_CLARITY} select image_id, bx, yy as block_y, round(v, 6) as value from value",
    "q23_features": f"with {_turned_sql(32, 16, 0, 0.0)}{_STRUCTURE}{_CLARITY} select image_id, {_BINS(slanted.CLARITY_BOUNDS)}, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as sd from value group by 1",
    "q24_uniformity": f"""with {_turned_sql(32, 16, 2, 0.0)}{_STRUCTURE},
l as (select image_id, bx, yy, list(place order by place) as p, first(ended order by place) as e from d where place < 30 group by all),
z as (select image_id, bx, yy, len(p) as m, (not e)::int as begins, p, unnest(range(len(p) - 3)) as i from l where len(p) > 3),
q as (select image_id, bx, yy, i, begins, (p[m - i] - p[m - i - 1])::double / (p[m - i - 1] - p[m - i - 2]) as ratio from z)
select image_id, bx, yy as block_y, i as turn, round(case when i >= begins and (i - begins) % 2 = 0 then 1 / ratio else ratio end, 6) as value from q""",
    "q25_frequencies": f"with {_SPECTRUM} select image_id, bx, yy as block_y, round(v, 6) as value from value",
    "q25_features": f"with {_SPECTRUM} select image_id, case when count(*) < 10 then 'not enough blocks' end as error, case when count(*) >= 10 then round(avg(v), 6) end as mean, case when count(*) >= 10 then round(stddev_pop(v), 6) end as sd from value group by 1",
}
