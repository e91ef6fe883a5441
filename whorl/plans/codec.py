"""Queries of trees, wavelet levels, bins and entropy coding over the driver's tables, with their SQL.

Rasters, variances and coefficients are made by rule from ``supplier``, sizes from
``part``. Each SQL is written from the base columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import binning, entropy, wavelets
from ..operators.checkpoints import saved
from ..operators.tiles import spread

WIDTH, HEIGHT, COEFFICIENTS = 64, 72, 600


def _keys(spark, sf_dir: str, table: str = "supplier") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _raster(spark, sf_dir: str) -> DataFrame:
    x, y, key = F.col("x"), F.col("y"), F.col("image_id")
    each = spread(_keys(spark, sf_dir), "s_suppkey", WIDTH * HEIGHT).select(F.col("s_suppkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))))
    return each.select("image_id", "x", "y", ((key * 31 + x * 7 + y * 13 + F.floor(x * y / 5)) % 256 - 128).cast("double").alias("c"))


_R = f"""r as (select s_suppkey as image_id, x, y, ((s_suppkey * 31 + x * 7 + y * 13 + (x * y) // 5) % 256 - 128)::double as c from supplier, range({WIDTH}) a(x), range({HEIGHT}) b(y))"""


def w12_trees(spark, sf_dir):
    """Both trees of every size that parts have."""
    sizes = _keys(spark, sf_dir, "part").select((F.col("p_size") * 5 + 40).cast("int").alias("width"), (F.col("p_partkey") % 37 * 3 + 41).cast("int").alias("height"))
    found = wavelets.trees(sizes)
    return found.select(*(F.col(c).cast("long") for c in ("width", "height")), "kind", *(F.col(c).cast("long") for c in ("node", "x", "y", "node_width", "node_height")))


def _tree_sql(sizes: str) -> str:
    """``tree``: the trees of ``sizes``, halved step by step along the paths."""
    rows = ", ".join(f"('{kind}', {node}, '{x}', '{y}')" for kind, node, x, y in wavelets.paths())
    larger, smaller = "(n + 1) // 2", "n // 2"
    first = f"case when substr(path, i, 1) in ('f', 's') then {larger} else {smaller} end"
    late = "substr(path, i, 1) in ('s', 'S')"
    return f"""paths(kind, node, x_path, y_path) as (values {rows}),
todo as (select distinct width as size, x_path as path from ({sizes}), paths union select distinct height, y_path from ({sizes}), paths),
halved as (select size, path, 1 as i, 0::bigint as place, size::bigint as n from todo
 union all select size, path, i + 1, case when {late} then place + {first} else place end, case when {late} then n - ({first}) else {first} end from halved where i <= length(path)),
whole as (select size, path, place, n from halved where i = length(path) + 1),
tree as (select s.width::bigint as width, s.height::bigint as height, kind, node::bigint as node, a.place as x, b.place as y, a.n as node_width, b.n as node_height from (select distinct width, height from ({sizes})) s, paths p join whole a on a.path = x_path and a.size = s.width join whole b on b.path = y_path and b.size = s.height)"""


def w19_wavelet(spark, sf_dir):
    """Sums over each slot of the whole transform."""
    found = wavelets.slots_of(wavelets.decompose(_raster(spark, sf_dir)))
    add = lambda f: F.aggregate("v", F.lit(0.0), lambda t, v: t + f(v))
    each = found.select("image_id", "slot", F.size("v").alias("n"), add(lambda v: v).alias("s"), add(lambda v: v * v).alias("q"), add(F.abs).alias("a"), (F.col("row") * add(lambda v: v)).alias("placed"))
    sums = each.groupBy("image_id", F.col("slot").cast("long")).agg(F.sum("n").cast("long").alias("n"), *(F.round(F.sum(c), 3).alias(name) for c, name in (("s", "total"), ("a", "size"), ("placed", "placed"))), F.round(F.sqrt(F.sum("q")), 3).alias("norm"))
    return sums.withColumns({c: F.col(c) + 0.0 for c in ("total", "placed")})


def _levels_sql() -> str:
    """Coefficients ``r0``, ``r1``, ... after each pass, as joins with the taps of every output place."""
    taps = ", ".join(f"({high}, {k - len(t) // 2}, {v!r})" for high, t in ((0, wavelets.LOW), (1, wavelets.HIGH)) for k, v in enumerate(t))
    out, now = [f"taps(high, k, weight) as (values {taps})", "r0 as (select * from r)"], 0
    for level in wavelets.LEVELS:
        for axis, cross, turned in (("x", "y", wavelets.TURNED_ROWS), ("y", "x", wavelets.TURNED_COLUMNS)):
            size, deep = ("node_width", "node_height") if axis == "x" else ("node_height", "node_width")
            at = "2 * i + high + k"
            mirrored = f"case when abs({at}) >= n then 2 * (n - 1) - abs({at}) else abs({at}) end"
            out += [
                f"n{now} as (select node, {axis} as a0, {cross} as b0, {size} as n, {deep} as m, node in {turned} as turned from tree where kind = 'node' and node in ({', '.join(map(str, level))}))",
                f"o{now} as (select *, case when turned then (j < n // 2)::int else (j >= (n + 1) // 2)::int end as high, case when turned and j >= n // 2 then j - n // 2 when not turned and j >= (n + 1) // 2 then j - (n + 1) // 2 else j end as i from (select *, unnest(range(n)) as j from n{now}))",
                f"w{now} as (select a0 + j as place, a0 + {mirrored} as source, b0, b0 + m as b1, sum(weight) as weight from o{now} join taps using (high) group by all)",
                f"r{now + 1} as (select image_id, {'place' if axis == 'x' else 'x'} as x, {'place' if axis == 'y' else 'y'} as y, sum(c * weight) as c from r{now} join w{now} on {axis} = source and {cross} >= b0 and {cross} < b1 group by all union all select image_id, x, y, c from r{now} where not exists (select 1 from n{now} where {axis} >= a0 and {axis} < a0 + n and {cross} >= b0 and {cross} < b0 + m))",
            ]
            now += 1
    return ", ".join(out) + f", done as (select * from r{now})"


def w15_round_trip(spark, sf_dir):
    """Largest distance of each raster from itself after the transform and back."""
    apart = F.zip_with("v", "back", lambda v, back: F.abs(v - back))
    both = wavelets.round_trip(_raster(spark, sf_dir)).select("image_id", apart.alias("apart"))
    return both.select("image_id", F.size(F.array_compact("apart")).cast("long").alias("n"), F.round(F.array_max("apart"), 6).alias("worst"))


def _variances(spark, sf_dir: str) -> DataFrame:
    """60 variances per supplier, of which some lie below the least one."""
    key = F.col("s_suppkey")
    value = lambda i: ((i * 37 + key * 101 + i * i * (key % 7)) % 4000) / (F.lit(1.0) + (i * (1 + key % 3)))
    return _keys(spark, sf_dir).select(key.alias("image_id"), F.transform(F.sequence(F.lit(0), F.lit(59)), value).alias("variances"))


def w21_bins(spark, sf_dir):
    found = saved(binning.bins(_variances(spark, sf_dir))).select("image_id", F.posexplode(F.arrays_zip("q", "z")).alias("subband", "s"))
    return found.select("image_id", F.col("subband").cast("long"), F.round("s.q", 6).alias("q"), F.round("s.z", 6).alias("z"))


def w22_trace(spark, sf_dir):
    # A generator over the fold itself would repeat it for each of its columns.
    found = saved(binning.bins(_variances(spark, sf_dir))).select("image_id", F.inline("rounds"))
    return found.select("image_id", F.col("round").cast("long"), F.col("n_active").cast("long"), *(F.round(c, 6).alias(c) for c in ("area", "product", "scale")), F.array_join("removed", ",").alias("removed"))


_BINS = f"""v as (select s_suppkey as image_id, list_transform(range(60), lambda i: ((i * 37 + s_suppkey * 101 + i * i * (s_suppkey % 7)) % 4000) / (1.0::double + i * (1 + s_suppkey % 3))) as vs from supplier),
b as (select image_id, list_transform(range(60), lambda i: case when vs[i + 1] >= 1.01 then {{'i': i, 'sigma': sqrt(vs[i + 1]), 'q': case when i < 4 then 1.0::double else 10 / ((case {" ".join(f"when i = {52 + k} then {w}" for k, w in enumerate(binning.WEIGHTS))} else 1.0 end)::double * ln(vs[i + 1])) end, 'a': case when i < 4 then 1 / 1024.0::double when i < 51 then 1 / 256.0::double else 1 / 16.0::double end}} end) as bands from v),
rounds as (select image_id, bands, list_filter(bands, lambda b: b is not null) as act, 0 as round, false as done, null::double as area, null::double as product, null::double as scale, null::struct(i bigint, sigma double, q double, a double)[] as gone, 0 as n_active from b
 union all select image_id, bands, list_filter(act, lambda b: not b.q / scale >= 5 * b.sigma), round + 1, len(list_filter(act, lambda b: b.q / scale >= 5 * b.sigma)) = 0, area, product, scale, list_filter(act, lambda b: b.q / scale >= 5 * b.sigma), len(act)
 from (select *, power(2, 2.25 / area - 1) / 2.5 / power(product, 1 / area) as scale from (select image_id, bands, act, round, list_sum(list_transform(act, lambda b: b.a)) as area, list_aggregate(list_transform(act, lambda b: power(b.sigma / b.q, b.a)), 'product') as product from rounds where not done and len(act) > 0))),
ended as (select image_id, bands, scale from rounds where round > 0 qualify row_number() over (partition by image_id order by round desc) = 1)"""


def _coefficients(spark, sf_dir: str) -> DataFrame:
    """600 coefficients per supplier in blocks of 100, 200 and 300, with a zero run of up to 280 and values of every symbol class."""
    key, i = F.col("image_id"), F.col("i")
    each = spread(_keys(spark, sf_dir), "s_suppkey", COEFFICIENTS).select(F.col("s_suppkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(COEFFICIENTS - 1))).alias("i"))
    v = F.when((i >= 310) & (i <= 310 + key * 37 % 280), 0).when((i * 7 + key * 3) % 10 < 5, 0).when(i % 97 == 5, 76 + i * key % 170).when(i % 89 == 7, -(300 + key % 500)).when(i % 83 == 11, 256 + key % 700).when(i % 79 == 3, -(74 + i % 100)).otherwise((i * i + key) % 21 - 10)
    block = F.when(i < 100, 0).when(i < 300, 1).otherwise(2)
    return each.select("image_id", block.alias("block"), (i - F.when(i < 100, 0).when(i < 300, 100).otherwise(300)).alias("place"), v.cast("int").alias("v"))


_C = f"""c as (select image_id, case when i < 100 then 0 when i < 300 then 1 else 2 end as block, case when i < 100 then i when i < 300 then i - 100 else i - 300 end as place,
 case when i between 310 and 310 + image_id * 37 % 280 then 0 when (i * 7 + image_id * 3) % 10 < 5 then 0 when i % 97 = 5 then 76 + i * image_id % 170 when i % 89 = 7 then -(300 + image_id % 500) when i % 83 = 11 then 256 + image_id % 700 when i % 79 = 3 then -(74 + i % 100) else (i * i + image_id) % 21 - 10 end as v
 from (select s_suppkey as image_id from supplier), range({COEFFICIENTS}) t(i))"""
_S = f"""{_C},
z as (select image_id, block, min(place) as place, count(*) as n from (select *, place - row_number() over (partition by image_id, block, v = 0 order by place) as g from c where v = 0) group by image_id, block, g),
s as (select image_id, block, place, case when n <= 100 then n when n <= 255 then 105 else 106 end as symbol, case when n <= 100 then 0 else n end as extra, case when n <= 100 then 0 when n <= 255 then 8 else 16 end as n_extra from z
 union all select image_id, block, place, case when v > 255 then 103 when v > 74 then 101 when v < -255 then 104 when v < -73 then 102 else v + 180 end, case when v > 74 or v < -73 then abs(v) else 0 end, case when abs(v) > 255 then 16 when v > 74 or v < -73 then 8 else 0 end from c where v <> 0),
h as (select image_id, (block > 0)::int as tbl, symbol, count(*) as n from s group by all union all select distinct image_id, (block > 0)::int, 256, 1 from s)"""
_T = f"""{_S},
tree as (select image_id, tbl, list_sort(list({{'n': n, 's': -symbol, 'm': [symbol]}})) as l, []::bigint[] as log from h group by all
 union all select image_id, tbl, list_sort(list_append(l[3:], {{'n': l[1].n + l[2].n, 's': l[1].s, 'm': list_concat(l[1].m, l[2].m)}})), list_concat(log, list_concat(l[1].m, l[2].m)) from tree where len(l) > 1),
lengths as (select image_id, tbl, symbol, count(*) as length from (select image_id, tbl, unnest(log) as symbol from tree where len(l) = 1) where symbol <> 256 group by all),
k as (select image_id, tbl, symbol, length, (coalesce(sum(1 << (16 - length)) over (partition by image_id, tbl order by length, symbol rows between unbounded preceding and 1 preceding), 0)::bigint >> (16 - length)) as code from lengths)"""


def w25_symbols(spark, sf_dir):
    found = entropy.histogram(entropy.symbols(_coefficients(spark, sf_dir)))
    return found.select("image_id", F.col("table").cast("long").alias("tbl"), F.col("symbol").cast("long"), "n")


def w26_codes(spark, sf_dir):
    found = entropy.codes(entropy.tables(entropy.histogram(entropy.symbols(_coefficients(spark, sf_dir)))))
    return found.select("image_id", F.col("table").cast("long").alias("tbl"), F.col("symbol").cast("long"), F.col("length").cast("long"), F.col("code").cast("long"))


def _blocks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    symbols = entropy.symbols(_coefficients(spark, sf_dir))
    tables = entropy.tables(entropy.histogram(symbols))
    return entropy.blocks(symbols, entropy.codes(tables)), tables


def w27_blocks(spark, sf_dir):
    packed, _ = _blocks(spark, sf_dir)
    return packed.select("image_id", F.col("block").cast("long"), F.octet_length("data").cast("long").alias("n_bytes"), F.hex("data").alias("data"))


def w11_coefficients(spark, sf_dir):
    """Coefficients, to blocks of bytes, and back."""
    packed, tables = _blocks(spark, sf_dir)
    n = F.when(F.col("block") == 0, 100).when(F.col("block") == 1, 200).otherwise(300)
    found = entropy.coefficients(packed.withColumn("n", n), tables)
    return found.select("image_id", F.col("block").cast("long"), "place", F.col("v").cast("long"), "error")


QUERIES = {f.__name__: f for f in (w12_trees, w19_wavelet, w15_round_trip, w21_bins, w22_trace, w25_symbols, w26_codes, w27_blocks, w11_coefficients)}
_SIZES = "select p_size * 5 + 40 as width, p_partkey % 37 * 3 + 41 as height from part"
_ONE = f"select {WIDTH} as width, {HEIGHT} as height"
ORACLES = {
    "w12_trees": f"with recursive {_tree_sql(_SIZES)} select * from tree",
    "w19_wavelet": f"with recursive {_R}, {_tree_sql(_ONE)}, {_levels_sql()} select image_id, t.node as slot, count(*) as n, round(sum(c), 3) + 0.0 as total, round(sum(abs(c)), 3) as size, round(sum(c * (d.y - t.y)), 3) + 0.0 as placed, round(sqrt(sum(c * c)), 3) as norm from done d join tree t on t.kind = 'slot' and d.x >= t.x and d.x < t.x + node_width and d.y >= t.y and d.y < t.y + node_height group by all",
    "w15_round_trip": f"select s_suppkey as image_id, {WIDTH * HEIGHT}::bigint as n, 0.0::double as worst from supplier",
    "w21_bins": f"with recursive {_BINS} select image_id, i::bigint as subband, round(coalesce(q, 0), 6) as q, round(coalesce(1.2 * q, 0), 6) as z from (select b.image_id, unnest(range(60)) as i, unnest(list_transform(b.bands, lambda x: x.q / scale)) as q from b left join ended e on e.image_id = b.image_id)",
    "w22_trace": f"with recursive {_BINS} select image_id, (round - 1)::bigint as round, n_active::bigint as n_active, round(area, 6) as area, round(product, 6) as product, round(scale, 6) as scale, array_to_string(list_transform(gone, lambda b: b.i), ',') as removed from rounds where round > 0",
    "w25_symbols": f"with {_S} select image_id, tbl::bigint as tbl, symbol::bigint as symbol, n from h",
    "w26_codes": f"with recursive {_T} select image_id, tbl::bigint as tbl, symbol::bigint as symbol, length, code from k",
    "w27_blocks": f"""with recursive {_T},
bits as (select s.image_id as image_id, block, string_agg(lpad(bin(code), length::int, '0') || case when n_extra > 0 then lpad(bin(extra::bigint), n_extra, '0') else '' end, '' order by place) as b from s join k on k.image_id = s.image_id and tbl = (block > 0)::int and k.symbol = s.symbol group by s.image_id, block),
bytes as (select image_id, block, i, list_sum(list_transform(range(8), lambda j: case when substr(b || '1111111', (i * 8 + j + 1)::bigint, 1) = '1' then 1 << (7 - j) else 0 end))::bigint as v from (select image_id, block, b, unnest(range((length(b) + 7) // 8)) as i from bits)),
texts as (select image_id, block, string_agg(printf('%02X', v) || case when v = 255 then '00' else '' end, '' order by i) as data from bytes group by all)
select image_id, block::bigint as block, (length(data) // 2)::bigint as n_bytes, data from texts""",
    "w11_coefficients": f"with {_C} select image_id, block::bigint as block, place::bigint as place, v::bigint as v, null::varchar as error from c",
}
