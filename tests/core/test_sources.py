"""Readers, writers and streams on files made here, and faults that are no SQL."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(__file__)))
sys.path[:0] = [os.path.dirname(__file__), ROOT]

from test_framing import BINARY, FIRST, IMAGE, LAST  # noqa: E402

from whorl.operators import pixels, reports, transactions  # noqa: E402
from whorl.sources import files  # noqa: E402
from whorl.sources.nist import NistSource  # noqa: E402
from whorl.streaming.files import measure_windows, record_stream  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture
def folder(tmp_path):
    for name, data in (("a.an2", FIRST + IMAGE + BINARY + LAST), ("b.an2", FIRST + LAST), ("c.an2", b"no record\x1c")):
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def plain(rows):
    return sorted((r["path"].rsplit("/", 1)[-1], r["record_index"], r["type"], r["byte_offset"], r["size"], tuple(r["pieces"] or ()), r["error"], r["data"] and bytes(r["data"])) for r in rows)


def test_reader_source_and_stream_agree(spark, folder, tmp_path_factory):
    want = plain(files.read_records(spark, folder).collect())
    assert [w[2] for w in want] == [1, 10, 4, 2, 1, 2, None] and want[-1][6] == 1000
    spark.dataSource.register(NistSource)
    assert plain(spark.read.format("nist").option("path", folder).load().collect()) == want
    assert plain(spark.read.format("nist").load(f"{folder}/b.an2").collect()) == [w for w in want if w[0] == "b.an2"]
    query = record_stream(spark, folder, files_per_trigger=1).writeStream.format("memory").queryName("records").option("checkpointLocation", str(tmp_path_factory.mktemp("ck"))).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert plain(spark.table("records").collect()) == want


def test_files_are_written_as_they_were_read(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    back = transactions.encode_files(files.read_records(spark, folder, "[ab].an2"))
    assert files.write_files(back, out).selectExpr("sum(n_bytes) as n").first()["n"] == sum(os.path.getsize(f"{folder}/{x}") for x in ("a.an2", "b.an2"))
    for name in ("a.an2", "b.an2"):
        with open(f"{out}/{name}", "rb") as new, open(f"{folder}/{name}", "rb") as old:
            assert new.read() == old.read()


def test_rasters_need_their_exact_size(spark, tmp_path):
    (tmp_path / "x.raw").write_bytes(bytes(range(12)))
    (tmp_path / "y.raw").write_bytes(b"123")
    (tmp_path / "sizes.json").write_text('[{"fileName": "x.raw", "width": 4, "height": 3}, {"fileName": "y.raw", "width": 2, "height": 2}]')
    got = files.raw_rasters(files.binary_files(spark, str(tmp_path), "*.raw"), files.size_catalogue(spark, f"{tmp_path}/sizes.json"))
    assert [(r["image_id"], r["width"]) for r in got.collect()] == [("x.raw", 4)]
    assert sorted(map(tuple, pixels.from_bytes(got).where("y = 1").drop("image_id").collect())) == [(x, 1, 4 + x) for x in range(4)]


def test_reports_are_read_and_repeated_names_fail(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Filename,score,note\n"a/1.png",5,"x, ""y"""\nb/2.png,na,NA\n')
    report = files.read_report(spark, f"{tmp_path}/r.csv")
    assert sorted(map(tuple, report.collect()), key=str) == [("a/1.png", "5", 'x, "y"'), ("b/2.png", None, None)]
    assert reports.compare(report, report, ["Filename", "score"]).count() == 0
    with pytest.raises(Exception, match="duplicate file name"):
        reports.compare(report.union(report.replace("a/1.png", "z\\1.png")), report, ["score"]).collect()
    assert reports.compared_columns(["a", "QB_x"], ["QB_x", "a", "b"], ["a"]) == ["a", "QB_x"]
    assert reports.compared_columns(["b", "a", "c"], ["a", "b"], ["a", "b"]) == ["b", "a"]
    with pytest.raises(ValueError, match="QB_x"):
        reports.compared_columns(["a", "QB_x"], ["a"], ["a"])


def test_blank_images_and_missing_measures(spark):
    white = spark.createDataFrame([(1, x, y, 255) for x in range(3) for y in range(3)], "image_id int, x int, y int, v int")
    assert [r["errors"] for r in pixels.crop_bounds(white).collect()] == [[1006]]
    assert pixels.crop(white).count() == 0 and pixels.otsu(white).count() == 0
    tree = {"feature": "a", "threshold": 1.0, "left": {"class": 0}, "right": {"class": 1}}
    rows = spark.createDataFrame([(1, 0.5), (2, 2.0)], "image_id int, a double")
    assert sorted(map(tuple, reports.forest_scores(rows, [tree]).collect())) == [(1, 0, 0), (2, 1, 100)]
    with pytest.raises(Exception, match="missing measure a"):
        reports.forest_scores(rows.selectExpr("image_id", "cast(null as double) as a"), [tree]).collect()


def test_windows_run_on_a_stream(spark, tmp_path, tmp_path_factory):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "m", 1.0), ("2024-01-01 00:09:00", "m", 3.0), ("2024-01-01 00:11:00", "m", 5.0)], "ts string, name string, value double").selectExpr("cast(ts as timestamp) as ts", "name", "value")
    rows.write.parquet(f"{tmp_path}/in")
    stream = measure_windows(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path_factory.mktemp("ck"))).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["n"], r["mean"]) for r in spark.table("windows").collect()) == [(1, 5.0), (2, 2.0)]
    assert measure_windows(rows).count() == 2


def test_paths_keep_their_folders_and_repeats_fail(spark, tmp_path):
    rows = [("in/a/x.nst", b"1"), ("in/b/x.nst", b"22"), ("in/b/c/y.nst", None)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    assert sorted(map(tuple, files.write_files(df, str(tmp_path / "out")).collect())) == [("in/a/x.nst", 1), ("in/b/c/y.nst", 0), ("in/b/x.nst", 2)]
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*.nst")} == {"a/x.nst": b"1", "b/x.nst": b"22", "b/c/y.nst": b""}
    for bad in ([("a", b"1"), ("a", b"2")], [(None, b"1")], [("a/../../b", b"1")]):
        with pytest.raises(ValueError):
            files.write_files(spark.createDataFrame(bad, "path string, content binary"), str(tmp_path / "out"))
    assert files.write_files(df.limit(0), str(tmp_path / "none")).count() == 0


def test_cells_with_quotes_anywhere(spark):
    from pyspark.sql import functions as F

    def plain(line):
        cells, now, quoted, i = [], "", False, 0
        while i < len(line):
            c = line[i]
            if c == '"' and quoted and line[i + 1 : i + 2] == '"':
                now, i = now + '"', i + 1
            elif c == '"':
                quoted = not quoted
            elif c == "," and not quoted:
                cells, now = [*cells, now], ""
            else:
                now += c
            i += 1
        return [None if x.upper() == "NA" else x for x in [*cells, now]]

    import random

    rng = random.Random(1)
    lines = ['a"b,c', 'a"b,c",d', '"x ""y""",na,', "", ",", ",,", '"', '""', '""""', 'a""b', '"a"b"c,d"'] + ["".join(rng.choice('a",b') for _ in range(rng.randrange(12))) for _ in range(400)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", files.report_cells(F.col("x")).alias("c")).collect()
    assert {r["i"]: r["c"] for r in got} == {i: plain(x) for i, x in enumerate(lines)}


def test_a_whole_report_is_read_back(spark, tmp_path):
    schema = "place int, Filename string, FingerCode int, UnifiedQualityScore int, OptionalError string, Quantized boolean, Resampled boolean, actionable map<string,double>, native map<string,double>, mapped map<string,double>"
    rows = [(0, 'b/"2",x.png', 1, 54, None, False, True, {"UniformImage": 1.5}, {"Mu": 0.1, "AA": 3.0}, {"QB_Mu": 7.0}), (1, "a.png", 2, 9, "bad, image", True, False, {}, {"Zz": -1e-9}, {})]
    columns = files.write_report(spark.createDataFrame(rows, schema), str(tmp_path / "r"))
    assert columns == [*files.FIXED, *files.ACTIONABLE, "AA", "Mu", "Zz", "QB_Mu"]
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.split("\n")[0] == ",".join(columns) and text.split("\n")[1].startswith('"b/""2"",x.png",1,54,NA,0,1,1.5,NA,NA,NA,3,0.1,NA,7')
    (tmp_path / "one.csv").write_text(text)
    back = {r["Filename"]: r.asDict() for r in files.read_report(spark, f"{tmp_path}/one.csv").collect()}
    assert back["a.png"]["Zz"] == "-1.0E-9" or float(back["a.png"]["Zz"]) == -1e-9
    assert back['b/"2",x.png']["OptionalError"] is None and back["a.png"]["OptionalError"] == "bad, image" and back["a.png"]["Mu"] is None


def test_empty_cells_stay_empty(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Filename,score,note\na,,NA\n")
    assert [tuple(r) for r in files.read_report(spark, f"{tmp_path}/e.csv").collect()] == [("a", "", None)]


def test_every_length_tag_counts_itself(spark):
    from pyspark.sql import functions as F

    def plain(values):
        text, n = lambda n: "\x1d".join(f"1.{k:03d}:{n if k == 1 else v}" for k, v in values) + "\x1c", ""
        while n != str(len(text(n))):
            n = str(len(text(n)))
        return text(n)

    cases = [[(1, ""), (2, "x"), (1, "9")], [(1, "7"), (2, "y" * k)] if (k := 84) else [], [(1, ""), (1, ""), (1, ""), (2, "z" * 70)], [(1, ""), (3, "")]]
    rows = spark.createDataFrame([(i, [(1, k, v) for k, v in c]) for i, c in enumerate(cases)], "i int, f array<struct<record_type:int,field_number:int,value:string>>")
    got = {r["i"]: r["t"] for r in rows.select("i", transactions.encode_record(F.col("f")).alias("t")).collect()}
    assert got == {i: plain(c) for i, c in enumerate(cases)}


def test_types_that_were_not_announced_and_files_without_records(spark):
    wrong = FIRST + LAST + IMAGE
    df = spark.createDataFrame([("w", wrong), ("e", b""), ("n", None), ("x", b"1.002:5\x1c")], "path string, content binary")
    got = {(r["path"], r["record_index"]): r["error"] for r in transactions.decode_files(df).collect()}
    assert got == {("w", 0): None, ("w", 1): 1001, ("w", 2): 1001, ("e", None): None, ("n", None): 1000, ("x", 0): 1004}
    seen = {r["path"]: (r["record_count"], r["error"]) for r in transactions.inspect_files(transactions.decode_files(df)).collect()}
    assert seen == {"w": (3, 1001), "e": (0, None), "n": (0, 1000), "x": (1, 1004)}
    assert {r["path"]: bytes(r["content"]) for r in transactions.encode_files(transactions.decode_files(df.where("path = 'e'"))).collect()} == {"e": b""}


def test_an_empty_batch_and_values_beyond_a_byte(spark):
    from pyspark.sql import functions as F

    from whorl.functions import measures

    with pytest.raises(ValueError):
        reports.batch_paths(spark.createDataFrame([(" ",)], "path string"), "/d")
    name = next(iter(next(iter(measures.RANGES.values()))))
    row = spark.createDataFrame([(name, 1e9), (name, -1e9), ("other", 5.0)], "n string, v double").select(measures.block_overflow(F.col("n"), F.col("v")).alias("o"), measures.quality_block(F.col("n"), F.col("v")).alias("q")).collect()
    assert [tuple(r) for r in row] == [(True, None), (True, None), (False, None)]
