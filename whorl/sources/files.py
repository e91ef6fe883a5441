"""Files as DataFrames: transactions, rasters, reports and side files.

Each reader gives plain columns, so filters and projections reach the scan;
nothing is parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from ..functions.nist import bound
from ..operators import transactions

#: Schema of ``nist`` records as ``decode_files`` gives them.
RECORDS = "path string, record_index int, type int, byte_offset bigint, size bigint, pieces array<string>, error int, data binary"


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_records(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Records of transaction files, one row each; see ``decode_files``."""
    return transactions.decode_files(binary_files(spark, path, pattern))


def _shared_uri(spark: SparkSession, folder: str) -> str:
    """The folder as Hadoop's file systems name it: one without a scheme lies in the default one, not on each executor."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes one file per (path, content) row, in the tasks; returns path and bytes written.

    Files keep their place below the folder that all paths share. Repeated
    paths, paths that leave the folder and null paths are errors before anything is written.
    """
    spark = files.sparkSession
    named = files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))
    low, high, n_null = named.agg(F.min("path"), F.max("path"), F.count_if(F.col("path").isNull() | F.col("path").rlike(r"(^|/)\.\.(/|$)|/$"))).first()
    repeated = named.groupBy("path").count().where("count > 1").select("path").limit(1).collect()
    if n_null or repeated:
        raise ValueError(f"not a path of one file: {repeated[0]['path'] if repeated else 'null, .. or a folder'}")
    import os

    # The paths between the first and the last one share what these two share.
    shared = os.path.commonprefix([low or "", high or ""])
    start, uri = shared.rfind("/") + 1, _shared_uri(spark, folder)

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where = f"{root}/{name[start:]}"
                system.create_dir(where.rsplit("/", 1)[0], recursive=True)
                part = f"{where}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content or b"")
                system.move(part, where)  # a repeated task replaces the file as a whole
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "n_bytes"])

    return named.mapInArrow(run, "path string, n_bytes bigint")


def raw_rasters(files: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id (file name), width, height, pixels of raw files whose byte count fits a catalogue (fileName, width, height)."""
    name = F.element_at(F.split("path", r"[/\\]"), -1)
    named = files.select(name.alias("image_id"), F.col("content").alias("pixels"))
    held = sizes.select(F.col("fileName").alias("image_id"), "width", "height")
    return named.join(held, "image_id").where("length(pixels) = width * height").select("image_id", "width", "height", "pixels")


def size_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """fileName, width, height of a JSON list."""
    return spark.read.schema("fileName string, width int, height int").json(path, multiLine=True)


def gray_map(content: Column) -> Column:
    """Struct (width, height, pixels) of a binary P5 gray map of depth 255 with the exact number of pixels, or null.

    The header's parts are divided by white space or ``#`` comments up to a
    line end; one white space character ends it.
    """
    text = F.decode(content, "ISO-8859-1")
    gap = r"(?:[ \t\r\n\x0B\x0C]|#[^\n]*\n)+"
    header = rf"^P5{gap}([0-9]{{1,5}}){gap}([0-9]{{1,5}}){gap}255[ \t\r\n\x0B\x0C]"
    number = lambda i: F.regexp_extract(text, header, i).try_cast("int")
    size = F.length(F.regexp_extract(text, header, 0))
    pixels = F.substring(content, size + 1, F.greatest(F.octet_length(content) - size, F.lit(0)))
    return F.when(text.rlike(header) & (F.octet_length(pixels) == number(1) * number(2)), F.struct(number(1).alias("width"), number(2).alias("height"), pixels.alias("pixels")))


def side_files(files: DataFrame) -> DataFrame:
    """path and width, height, depth, ppi of NIST_COM side files."""
    number = lambda fields, key: images.value_in(fields, key).try_cast("int")
    values = lambda fields: F.struct(*(number(fields, f"PIX_{c.upper()}").alias(c) for c in ("width", "height", "depth")), F.coalesce(number(fields, "PPI"), F.lit(images.PPI)).alias("ppi"))
    # The lines of a text are taken apart once for all values.
    found = bound(images.comment_fields(F.decode("content", "UTF-8")), values)
    return files.select("path", found.alias("found")).select("path", "found.*")


def key_values(text: Column, mark: str) -> Column:
    """Array of (key, value) of the lines of a text that hold ``mark`` behind a key; both are trimmed."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.instr(x, mark) > 1)
    at = lambda x: F.instr(x, mark)
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring(x, F.lit(1), at(x) - 1)).alias("key"), F.trim(F.substring(x, at(x) + len(mark), F.length(x))).alias("value")))
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))


def model_info(text: Column, folder: Column) -> Column:
    """Struct (name, path, hash) of a model-info text; ``path`` is taken from ``folder`` unless absolute, null if path or hash is missing."""
    last = lambda key: F.try_element_at(F.filter(key_values(text, "="), lambda p: p["key"] == key), F.lit(-1))["value"]
    path = F.when(F.startswith(last("Path"), F.lit("/")), last("Path")).otherwise(F.concat(folder, F.lit("/"), last("Path")))
    return F.when(last("Path").isNotNull() & last("Hash").isNotNull(), F.struct(last("Name").alias("name"), path.alias("path"), last("Hash").alias("hash")))


def measure_text(text: Column) -> Column:
    """Array of (name, value) of a ``Name: value`` report."""
    return F.transform(key_values(text, ":"), lambda p: F.struct(p["key"].alias("name"), p["value"].try_cast("double").alias("value")))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A quality report in CSV, all columns as text; ``NA`` in any case is null, an empty cell stays empty."""
    found = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    cell = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    return found.select(*(F.when(F.upper(cell(c)) != "NA", cell(c)).alias(c) for c in found.columns))


def number_text(value: Column) -> Column:
    """A double with up to 17 digits, the shortest text that reads back as the same number."""
    short = F.regexp_replace(value.cast("string"), r"\.0$", "")
    return F.when(value.isNull() | F.isnan(value), "NA").otherwise(short)


def report_line(cells: list[Column]) -> Column:
    """One CSV line: null is ``NA``, cells with a comma, quote or line end are quoted."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *(quoted(F.coalesce(c.cast("string"), F.lit("NA"))) for c in cells))


def report_cells(line: Column) -> Column:
    """Array of the cells of one CSV line; ``NA`` in any case is null.

    A quote anywhere in a cell begins or ends a quoted stretch, in which commas
    belong to the cell and a doubled quote is one; an open stretch runs to the end.
    """
    stretch = r'"((?:[^"]++|"")*+)(?:"|$)'
    # The comma in front makes every cell a match of its own.
    raw = F.regexp_extract_all(F.concat(F.lit(","), F.trim(line)), F.lit(f",((?:[^\",]++|{stretch})*+)"), F.lit(1))
    plain = F.transform(raw, lambda c: F.replace(F.regexp_replace(c, stretch, "$1"), F.lit('""'), F.lit('"')))
    return F.transform(plain, lambda c: F.when(F.upper(c) != "NA", c))


# The first columns of a report.
FIXED = ("Filename", "FingerCode", "UnifiedQualityScore", "OptionalError", "Quantized", "Resampled")
ACTIONABLE = ("UniformImage", "EmptyImageOrContrastTooLow", "FingerprintImageWithMinutiae", "SufficientFingerprintForeground")


def report_columns(results: DataFrame, mapped: bool = True) -> list[str]:
    """Columns of a whole report: the fixed and actionable ones, then all native and all mapped names, each sorted.

    Only names of measures come to the driver, of which an algorithm has a fixed number.
    """
    names = lambda c: sorted(r[0] for r in results.select(F.explode(F.map_keys(c))).distinct().collect())
    return [*FIXED, *ACTIONABLE, *names("native"), *(names("mapped") if mapped else [])]


def report_lines(results: DataFrame, columns: list[str]) -> DataFrame:
    """``line`` and ``place`` of a whole report: the header has place -1, rows have the ``place`` of ``results``.

    ``results``: place, a column for each fixed one, and the maps ``actionable``,
    ``native`` and ``mapped`` of numbers. A name is looked up in this order; what is in none is NA.
    """
    number = lambda c: number_text(F.coalesce(*(F.try_element_at(m, F.lit(c)) for m in ("actionable", "native", "mapped"))))
    flag = lambda c: F.when(F.col(c), "1").otherwise("0")
    cell = lambda c: flag(c) if c in ("Quantized", "Resampled") else F.col(c).cast("string") if c in FIXED else number(c)
    rows = results.select(F.col("place").cast("long").alias("place"), report_line([cell(c) for c in columns]).alias("line"))
    head = results.sparkSession.range(1).select(F.lit(-1).cast("long").alias("place"), report_line([F.lit(c) for c in columns]).alias("line"))
    return head.union(rows)


def write_report(results: DataFrame, folder: str, mapped: bool = True) -> list[str]:
    """Writes a report as text files that follow each other in the order of their names; returns its columns."""
    columns = report_columns(results, mapped)
    report_lines(results, columns).orderBy("place").select("line").write.mode("overwrite").text(folder)
    return columns


FILE_JSON = "struct<records:array<struct<type:int,fields:array<struct<tag:string,value:string>>>>>"


def file_from_json(text: Column) -> Column:
    """Bytes of a transaction given as JSON: records with fields of (tag, value)."""
    from ..functions import nist

    fields = lambda r: F.transform(r["fields"], lambda f: F.struct(nist.parse_tag(f["tag"])["record_type"].alias("record_type"), nist.parse_tag(f["tag"])["field_number"].alias("field_number"), f["value"].alias("value")))
    return nist.latin1(F.array_join(F.transform(F.from_json(text, FILE_JSON)["records"], lambda r: transactions.encode_record(fields(r))), ""))
