"""Regions, wavelets, bins and entropy coding against plain versions, with hard inputs."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))

from whorl.operators import binning, entropy, regions, wavelets  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def flood(free, starts, moves):
    """Cells reachable from ``starts`` over free ones."""
    seen, todo = set(starts), list(starts)
    while todo:
        y, x = todo.pop()
        for dy, dx in moves:
            p = (y + dy, x + dx)
            if p in free and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def plain_region(white):
    h, w = white.shape
    eight = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    cells = {(y, x) for y in range(h) for x in range(w)}
    light = {p for p in cells if white[p]}
    open_ = flood(light, [p for p in light if p[0] in (0, h - 1) or p[1] in (0, w - 1)], eight)
    dark, best, area = cells - open_, set(), -1
    for p in sorted(dark):
        if p in dark:
            part = flood(dark, [p], [(0, 1), (1, 0), (0, -1), (-1, 0)])
            dark -= part
            ys, xs = zip(*part, strict=True)
            if (size := (max(ys) - min(ys) + 1) * (max(xs) - min(xs) + 1)) > area:
                best, area = part, size
    return best


def test_components_of_random_masks_equal_a_flood_fill():
    rng = np.random.default_rng(1)
    for _ in range(600):
        h, w = rng.integers(1, 9, 2)
        white = rng.random((h, w)) < rng.choice([0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0])
        runs = []
        for x in range(w):
            cuts = [0, *(y for y in range(1, h) if white[y, x] != white[y - 1, x]), h]
            runs += [(x, a, b - 1, white[a, x]) for a, b in zip(cuts, cuts[1:], strict=False)]
        line, start, end = (np.array([r[i] for r in runs], np.int64) for i in range(3))
        kept = regions.largest_dark(line, start, end, np.array([r[3] for r in runs], bool))
        assert {(y, r[0]) for r, k in zip(runs, kept, strict=True) if k for y in range(r[1], r[2] + 1)} == plain_region(white)


def plain_filter(m, size, f):
    """A filter along the last axis, value by value."""
    out = np.empty_like(m)
    for i, row in enumerate(m):
        for j in range(len(row)):
            out[i, j] = f(row, j, size)
    return out


def reflected(i, n):
    while n > 1 and not 0 <= i < n:
        i = -i if i < 0 else 2 * n - i - 2
    return i if n > 1 else 0


def test_line_filters_equal_plain_ones():
    m = np.random.default_rng(2).integers(0, 256, (3, 17)).astype(float)
    erode = plain_filter(m, 5, lambda row, j, k: min([*row[max(0, j - 2) : j + 3], 255 if j < 2 or j > len(row) - 3 else row[j]]))
    assert (regions.eroded(m) == erode).all()
    for size in regions.BLURS:
        taps = regions.taps(size)
        blur = plain_filter(m, size, lambda row, j, k, taps=taps: sum(t * row[reflected(j + i - k // 2, len(row))] for i, t in enumerate(taps)))
        assert np.allclose(regions.blurred(m, size), blur, atol=1e-9)
    assert regions.rounded(np.array([[0.5, 1.4999999, 254.5, 300.0, 0.49999999999999994]])).tolist() == [[1, 1, 255, 255, 0]]


def test_an_image_without_dark_parts_has_no_region(spark):
    white = spark.range(40 * 33).selectExpr("1L as image_id", "cast(id % 40 as int) as x", "cast(id div 40 as int) as y", "255 as v")
    found = regions.region(white)
    row = regions.region_measures(white, found).first()
    assert found.count() == 0 and (row["region_pixels"], row["mean"], row["sd"], row["all_blocks"], row["complete_blocks"], row["region_blocks"]) == (0, 255.0, 0.0, 4, 1, 0)
    assert tuple(regions.coherence(white, found).first()) == (1, 0.0, 0.0)
    assert regions.region(white.limit(0)).count() == 0


def test_halves_of_any_length_join_again():
    rng = np.random.default_rng(0)
    for n in range(1, 60):
        for swap in (False, True):
            m = rng.normal(size=(3, n))
            parts = wavelets.analysed(m, swap)
            assert np.abs(wavelets.joined(parts, swap) - m).max() < 1e-9
            low = parts[:, n // 2 :] if swap else parts[:, : (n + 1) // 2]
            plain = [[sum(t * row[reflected(2 * i + k - 4, n)] for k, t in enumerate(wavelets.LOW)) for i in range((n + 1) // 2)] for row in m]
            assert np.allclose(low, plain)


def test_slots_cover_every_size(spark):
    sizes = spark.createDataFrame([(w, h) for w in (64, 65, 71, 100, 101, 545) for h in (64, 73, 90, 622)], "width int, height int")
    found = wavelets.trees(sizes.union(sizes)).where("kind = 'slot'").groupBy("width", "height").agg({"node": "count", "*": "count"}).collect()
    assert len(found) == 24 and all(r["count(node)"] == 64 for r in found)
    for w, h in ((65, 73), (100, 90)):
        covered = np.zeros((h, w), int)
        for r in wavelets.trees(sizes.where(f"width = {w} and height = {h}")).where("kind = 'slot'").collect():
            covered[r["y"] : r["y"] + r["node_height"], r["x"] : r["x"] + r["node_width"]] += 1
        assert (covered == 1).all()


def test_transform_and_back_of_odd_sizes(spark):
    rows = [(i, x, y, float((x * 7 + y * 13 + x * y // 3) % 251)) for i, (w, h) in enumerate([(67, 64), (64, 71)]) for x in range(w) for y in range(h)]
    raster = spark.createDataFrame(rows, "image_id long, x int, y int, c double")
    back = wavelets.reconstruct(wavelets.decompose(raster)).withColumnRenamed("c", "b")
    worst = raster.join(back, ["image_id", "x", "y"]).selectExpr("count(*) as n", "max(abs(c - b)) as worst").first()
    assert worst["n"] == len(rows) and worst["worst"] < 1e-6


def plain_bins(variances, rate=2.25):
    weight = {52 + i: w for i, w in enumerate((1.32, 1.08, 1.42, 1.08, 1.32, 1.42, 1.08, 1.08))}
    share = lambda i: 1 / (1024 if i < 4 else 256 if i < 51 else 16)
    took = [i for i, v in enumerate(variances) if (v or 0) >= 1.01]
    q = {i: 1.0 if i < 4 else 10 / (weight.get(i, 1.0) * np.log(variances[i])) for i in took}
    active, rounds, scale = list(took), 0, None
    while active:
        rounds += 1
        area = sum(map(share, active))
        product = np.prod([(np.sqrt(variances[i]) / q[i]) ** share(i) for i in active])
        scale = 2 ** (rate / area - 1) / 2.5 / product ** (1 / area)
        gone = [i for i in active if q[i] / scale >= 5 * np.sqrt(variances[i])]
        if not gone:
            break
        active = [i for i in active if i not in gone]
    return [q[i] / scale if i in q and active else 0.0 for i in range(60)], rounds


def test_bins_equal_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.choice([0.5, 1.01, 1.5, 3.0, 50.0, 4e4], 60, p=[0.2, 0.1, 0.3, 0.2, 0.1, 0.1]).tolist()) for i in range(12)]
    rows += [(20, [0.0] * 60), (21, [None] * 30 + [2.0] * 30), (22, [1e6] * 60)]
    got = {r["image_id"]: r for r in binning.bins(spark.createDataFrame(rows, "image_id int, variances array<double>")).collect()}
    for i, variances in rows:
        q, rounds = plain_bins(variances)
        assert np.allclose(got[i]["q"], q, rtol=1e-9) and np.allclose(got[i]["z"], np.array(q) * 1.2) and len(got[i]["rounds"]) == (rounds or 0)


def plain_symbols(values):
    out, i = [], 0
    while i < len(values):
        v, n = values[i], 1
        if v == 0:
            while i + n < len(values) and values[i + n] == 0 and n < 65535:
                n += 1
            out.append((n, 0, 0) if n <= 100 else (105, n, 8) if n < 256 else (106, n, 16))
        else:
            wide = abs(v) > 255
            out.append((103 if wide else 101, v, 16 if wide else 8) if v > 74 else (104 if wide else 102, -v, 16 if wide else 8) if v < -73 else (v + 180, 0, 0))
        i += n
    return out


def plain_block(values, codes):
    bits = "".join(format(codes[s][1], f"0{codes[s][0]}b") + (format(x, f"0{n}b") if n else "") for s, x, n in plain_symbols(values))
    bits += "1" * (-len(bits) % 8)
    raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    return raw.replace(b"\xff", b"\xff\x00")


@pytest.fixture(scope="module")
def coded(spark):
    rng = random.Random(5)
    rows, made = [], {}
    for image in range(6):
        for block, n in enumerate((300, 500, 900)):
            pool = [0] * 5 + list(range(-80, 81)) + [74, 75, -73, -74, 255, 256, -255, -256, 32767, -32767]
            values = []
            while len(values) < n:
                values += [0] * rng.choice([1, 99, 100, 101, 255, 256, 300]) if rng.random() < 0.05 else [rng.choice(pool)]
            made[image, block] = values[:n]
            rows += [(image, block, i, v) for i, v in enumerate(values[:n])]
    made[6, 0] = [0] * 70_000 + [5] + [0] * 65_535
    rows += [(6, 0, i, v) for i, v in enumerate(made[6, 0])]
    found = entropy.symbols(spark.createDataFrame(rows, "image_id long, block int, place long, v int")).cache()
    tables = entropy.tables(entropy.histogram(found)).cache()
    return made, found, tables


def test_symbols_and_codes(spark, coded):
    made, found, tables = coded
    for (image, block), values in made.items():
        rows = found.where(f"image_id = {image} and block = {block}").orderBy("place").collect()
        assert [(r["symbol"], r["extra"], r["n_extra"]) for r in rows] == plain_symbols(values)
    for r in tables.collect():
        assert sum(n / 2 ** (i + 1) for i, n in enumerate(r["counts"])) < 1 and sum(r["counts"]) == len(r["symbols"])
    ones = entropy.codes(tables).where("code = shiftleft(1, length) - 1").count()
    assert ones == 0


def test_blocks_and_back(spark, coded):
    from pyspark.sql import functions as F

    made, found, tables = coded
    codes = {}
    for r in entropy.codes(tables).collect():
        codes.setdefault((r["image_id"], r["table"]), {})[r["symbol"]] = (r["length"], r["code"])
    packed = entropy.blocks(found, entropy.codes(tables)).cache()
    for r in packed.collect():
        assert bytes(r["data"]) == plain_block(made[r["image_id"], r["block"]], codes[r["image_id"], int(r["block"] > 0)])
    sizes = spark.createDataFrame([(i, b, len(v)) for (i, b), v in made.items()], "image_id long, block int, n int")
    back = entropy.coefficients(packed.join(sizes, ["image_id", "block"]), tables)
    listed = back.groupBy("image_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda p: p.v).alias("v"), F.max("error").alias("error"))
    got = {(r["image_id"], r["block"]): r for r in listed.collect()}
    assert {k: r["v"] for k, r in got.items()} == made and not any(r["error"] for r in got.values())


def test_codes_stay_within_sixteen_bits():
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    lengths = entropy.code_lengths([*enumerate(fib[1:], 107), (entropy.SENTINEL, 1)])
    assert max(lengths.values()) > 16
    counts, symbols = entropy.limited(lengths)
    assert len(counts) == 16 and sum(counts) == len(symbols) == 29
    assert sum(n / 2 ** (i + 1) for i, n in enumerate(counts)) < 1
    assert entropy.limited(entropy.code_lengths([(entropy.SENTINEL, 1)])) == ([0] * 16, [])


def test_lengths_are_as_short_as_can_be():
    import heapq

    rng = random.Random(8)
    for _ in range(200):
        counted = [(s, rng.choice([1, 1, 2, 3, 50, 1000])) for s in range(1, rng.randint(2, 40))] + [(entropy.SENTINEL, 1)]
        lengths, heap, total = entropy.code_lengths(counted), sorted(n for _, n in counted), 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            total += both
            heapq.heappush(heap, both)
        assert sum(n * lengths[s] for s, n in counted) == total


def test_bad_blocks_give_errors():
    counts, values = (0, 1, 1) + (0,) * 13, (181, 101)  # codes 00 and 010
    ok = lambda bits: bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    assert entropy.decoded(ok("0000" + "1111"), counts, values, 2) == ([181, 181], [0, 0], None)
    assert entropy.decoded(ok("010" + "01100100" + "11111"), counts, values, 1) == ([101], [100], None)
    assert entropy.decoded(ok("00001111"), counts, values, 3)[2] in ("end", "code")
    assert entropy.decoded(ok("0101111"+"1"), counts, values, 1)[2] is not None
    assert entropy.decoded(b"\xff", counts, values, 1)[2] == "escape"
    assert entropy.decoded(b"\xff\x01", counts, values, 1)[2] == "marker"
    assert entropy.decoded(b"\xff\x00" * 3, counts, values, 1)[2] == "code"
    assert entropy.decoded(b"", counts, values, 0) == ([], [], None)
    assert entropy.decoded(b"\x00", counts, values, 0)[2] == "data"
    assert entropy.decoded(b"", counts, values, 1)[2] == "end"
    assert entropy.decoded(b"\x00", (1,) + (0,) * 15, (9,), 5)[2] == "run"
    assert entropy.decoded(b"\x00", (1,) + (0,) * 15, (255,), 5)[2] == "symbol"
