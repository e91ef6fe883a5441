"""Queries of the region of interest and its coherence over rasters made by rule from ``supplier``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import regions
from ..operators.tiles import spread

WIDTH, HEIGHT = 64, 60


def _raster(spark, sf_dir: str) -> DataFrame:
    """A dark oval on white per supplier, some with a hole, some with a second oval; every ninth image is all white."""
    key, x, y = F.col("image_id"), F.col("x"), F.col("y")
    each = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey", WIDTH * HEIGHT).select(F.col("s_suppkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))))
    square = lambda c: c * c
    oval = square(x - 28 - key % 7) * (2 + key % 3) + square(y - 30 + key % 5) <= 500
    hole = (key % 4 == 0) & (square(x - 28) + square(y - 30) < 30)
    second = (key % 3 == 0) & (square(x - 58) + square(y - 5) < 40)
    dark = (key % 9 != 0) & ((oval & ~hole) | second)
    return each.select("image_id", "x", "y", F.when(key % 9 == 0, 255).when(dark, (x * 7 + y * 13 + key * 31) % 120).otherwise(235 + (x + y + key) % 21).cast("int").alias("v"))


_R = f"""r as (select s_suppkey as image_id, x, y, case when s_suppkey % 9 = 0 then 255
 when ((x - 28 - s_suppkey % 7) ** 2 * (2 + s_suppkey % 3) + (y - 30 + s_suppkey % 5) ** 2 <= 500 and not (s_suppkey % 4 = 0 and (x - 28) ** 2 + (y - 30) ** 2 < 30)) or (s_suppkey % 3 = 0 and (x - 58) ** 2 + (y - 5) ** 2 < 40)
 then (x * 7 + y * 13 + s_suppkey * 31) % 120 else 235 + (x + y + s_suppkey) % 21 end::bigint as v from supplier, range({WIDTH}) a(x), range({HEIGHT}) b(y))"""


def _blur_sql(name: str, source: str, size: int) -> str:
    """Both passes of a blur over lists of lines, and the rounding."""
    taps = ", ".join(repr(float(t)) for t in regions.taps(size))

    def lines(part: str, of: str, line: str, at: str, n: int) -> str:
        place = f"abs(i + k - {size // 2})"
        mirrored = f"case when {place} >= {n} then {2 * n - 2} - {place} else {place} end"
        return f"""{part}_l as (select image_id, {line}, list(v::double order by {at}) as l from {of} group by all),
{part} as (select image_id, {line}, unnest(range({n})) as {at}, unnest(list_transform(range({n}), lambda i: list_sum(list_transform(range({size}), lambda k: ([{taps}])[k + 1] * l[{mirrored} + 1])))) as v from {part}_l)"""

    return f"""{lines(name + "_h", source, "y", "x", WIDTH)},
{lines(name + "_v", name + "_h", "x", "y", HEIGHT)},
{name} as (select image_id, x, y, floor(v)::bigint + case when v - floor(v) >= 0.5 then 1 else 0 end as v from {name}_v)"""


def _cut_sql(name: str, source: str) -> str:
    return f"""{name}_h as (select image_id, v, count(*)::double as n from {source} group by all),
{name}_c as (select image_id, v, sum(n) over w as w0, sum(n * v) over w as s0, sum(n) over (partition by image_id) as n, sum(n * v) over (partition by image_id) as s from {name}_h window w as (partition by image_id order by v)),
{name}_t as (select image_id, v as t from {name}_c where w0 < n qualify row_number() over (partition by image_id order by round(w0 * (n - w0) * (s0 / w0 - (s - s0) / (n - w0)) ** 2, 6) desc, v) = 1),
{name} as (select image_id, x, y, case when v > coalesce(t, 0) then 255 else 0 end as v from {source} left join {name}_t using (image_id))"""


_REGION = f"""{_R},
e1 as (select image_id, x, y, min(v) over (partition by image_id, y order by x rows between 2 preceding and 2 following) as v from r),
e as (select image_id, x, y, min(v) over (partition by image_id, x order by y rows between 2 preceding and 2 following) as v from e1),
{_blur_sql("b1", "e", regions.BLURS[0])}, {_cut_sql("c1", "b1")}, {_blur_sql("b2", "c1", regions.BLURS[1])}, {_cut_sql("c2", "b2")},
i1 as (select *, y - row_number() over (partition by image_id, x, v order by y) as g from c2),
runs as (select image_id, x, v, min(y) as a, max(y) as b from i1 group by image_id, x, v, g),
open as (select image_id, x, a, b from runs where v = 255 and (x in (0, {WIDTH - 1}) or a = 0 or b = {HEIGHT - 1})
 union select r.image_id, r.x, r.a, r.b from open o join runs r on r.image_id = o.image_id and r.v = 255 and abs(r.x - o.x) <= 1 and r.a <= o.b + 1 and r.b >= o.a - 1),
dark as (select c.image_id, c.x, c.y, c.y - row_number() over (partition by c.image_id, c.x order by c.y) as g from c2 c where v = 0 or not exists (select 1 from open o where o.image_id = c.image_id and o.x = c.x and c.y between o.a and o.b)),
d as (select image_id, x, min(y) as a, max(y) as b from dark group by image_id, x, g),
near as (select l.image_id, l.x, l.a, m.x as x2, m.a as a2 from d l join d m on l.image_id = m.image_id and abs(l.x - m.x) = 1 and l.a <= m.b and l.b >= m.a),
reach as (select image_id, x, a, x as rx, a as ra from d union select n.image_id, x2, a2, rx, ra from reach t join near n on n.image_id = t.image_id and n.x = t.x and n.a = t.a),
part as (select image_id, x, a, min(rx * 1000 + ra) as root from reach group by all),
box as (select image_id, root, (max(x) - min(x) + 1) * (max(b) - min(a) + 1) as area, min(a * {WIDTH} + x) as first from part join d using (image_id, x, a) group by image_id, root),
best as (select image_id, root from box qualify row_number() over (partition by image_id order by area desc, first) = 1),
region as (select image_id, x, a, b from best join part using (image_id, root) join d using (image_id, x, a)),
inside as (select image_id, x, y, v from r join region using (image_id, x) where y between a and b),
blocks as (select distinct image_id, x // 32 as cx, y // 32 as cy from inside)"""


def q15_region(spark, sf_dir):
    raster = _raster(spark, sf_dir)
    found = regions.region_measures(raster, regions.region(raster))
    return found.select(*(F.col(c).cast("long") for c in ("image_id", "all_blocks", "complete_blocks", "region_blocks", "image_pixels", "region_pixels")), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def q15_runs(spark, sf_dir):
    """The region itself: its runs in every column."""
    return regions.region(_raster(spark, sf_dir)).select(*(F.col(c).cast("long") for c in ("image_id", "x", "top", "bottom")))


def q16_coherence(spark, sf_dir):
    raster = _raster(spark, sf_dir)
    found = regions.coherence(raster, regions.region(raster))
    return found.select("image_id", F.round("coherence_sum", 6).alias("coherence_sum"), F.round("coherence_mean", 6).alias("coherence_mean"))


_SLOPE = "coalesce((lead(v) over {0} - lag(v) over {0}) / 2.0::double, lead(v) over {0} - v, v - lag(v) over {0}, 0)"
QUERIES = {f.__name__: f for f in (q15_region, q15_runs, q16_coherence)}
ORACLES = {
    "q15_region": f"""with recursive {_REGION},
sums as (select image_id, count(*) as n, avg(v) as mean, stddev_samp(v) as sd from inside group by 1), bs as (select image_id, count(*) as nb from blocks group by 1)
select s_suppkey as image_id, {-(-WIDTH // 32) * -(-HEIGHT // 32)}::bigint as all_blocks, {WIDTH // 32 * (HEIGHT // 32)}::bigint as complete_blocks, coalesce(nb, 0) as region_blocks, {WIDTH * HEIGHT}::bigint as image_pixels, coalesce(n, 0) as region_pixels, round(coalesce(mean, 255.0), 6) as mean, round(coalesce(sd, 0), 6) as sd from supplier left join sums on image_id = s_suppkey left join bs on bs.image_id = s_suppkey""",
    "q15_runs": f"with recursive {_REGION} select image_id, x, a as top, b as bottom from region",
    "q16_coherence": f"""with recursive {_REGION},
g as (select image_id, cx, cy, x, y, v from (select *, x // 32 as cx, y // 32 as cy from r) join blocks using (image_id, cx, cy)),
s as (select image_id, cx, cy, {_SLOPE.format("h")} as gx, {_SLOPE.format("w")} as gy from g window h as (partition by image_id, y, cx order by x), w as (partition by image_id, x, cy order by y)),
k as (select image_id, cx, cy, sqrt(sum(2 * gx * gy) ** 2 + sum(gx * gx - gy * gy) ** 2) as num, sum(sqrt((2 * gx * gy) ** 2 + (gx * gx - gy * gy) ** 2)) as den from s group by all),
t as (select image_id, sum(case when den > 0 then num / den else 0 end) as total, count(*) as n from k group by 1)
select s_suppkey as image_id, round(coalesce(total, 0), 6) as coherence_sum, round(coalesce(total / n, 0), 6) as coherence_mean from supplier left join t on image_id = s_suppkey""",
}
