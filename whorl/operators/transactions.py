"""Transactions as DataFrames: encode records, decode files, inspect, check.

A file is one row with a ``content`` binary. Records are framed by their stated
lengths in an Arrow kernel, the rest are native expressions; a bad file gives
an error row, never a failed job.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nist


def encode_record(fields: Column) -> Column:
    """Text of a fielded record from an array of (record_type, field_number, value).

    A length field is put first, or rewritten if the record starts with one;
    every later field of the same tag gets the length too.
    """
    first = F.get(fields, 0)
    rest = F.when(first["field_number"] == 1, F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0)))).otherwise(fields)
    is_length = lambda f: (f["field_number"] == 1) & (f["record_type"] == first["record_type"])
    piece = lambda f: F.struct(F.concat(F.lit(nist.GS), nist.tag(f["record_type"], f["field_number"]), F.lit(":")).alias("tag"), F.when(~is_length(f), F.coalesce(f["value"], F.lit(""))).alias("value"))
    head = F.concat(nist.tag(first["record_type"], F.lit(1)), F.lit(":"))
    # Parts are bound to lambda variables, so that each is evaluated once.
    text = lambda p, n: F.concat(p["head"], n, F.array_join(F.transform(p["pieces"], lambda f: F.concat(f["tag"], F.coalesce(f["value"], n))), ""), F.lit(nist.FS))
    size = lambda p: F.length(p["head"]) + 1 + F.aggregate(p["pieces"], F.lit(0), lambda n, f: n + F.length(f["tag"]) + F.coalesce(F.length(f["value"]), F.lit(0)))
    times = lambda p: 1 + F.size(F.filter(p["pieces"], lambda f: f["value"].isNull()))
    length = lambda p: nist.bound(F.struct(size(p).alias("size"), times(p).alias("times")), lambda s: nist.record_length(s["size"], s["times"]).cast("string"))
    sized = lambda p: nist.bound(length(p), lambda n: text(p, n))
    return nist.bound(F.struct(head.alias("head"), F.transform(rest, piece).alias("pieces")), sized)


_TAG = re.compile(rb"([0-9]{1,9})\.([0-9]{3}):")
_FIELD = re.compile(rb"\x1d(?=[0-9]+\.[0-9]{3}:)")
_INT = re.compile(rb"[+-]?[0-9]{1,10}")


def _announced(record: bytes) -> tuple[list[int | None], int | None]:
    """Types of the records after the first one by its field 1.003, and the error in it."""
    value = next((f[6:] for f in _FIELD.split(record) if f.startswith(b"1.003:")), b"")
    items = [x.split(b"\x1f")[0].strip() for x in value.split(b"\x1e")[1:]]
    types = [int(x) if _INT.fullmatch(x) and abs(int(x)) < 1 << 31 else None for x in items]
    return types, (1010 if b"" in items else 1011) if None in types else None


#: What is known of a record.
FRAME = ("type", "byte_offset", "size", "fielded", "data", "error")


def frames(content: bytes) -> list[dict]:
    """Logical records of one file; one that cannot be framed holds the rest and is the last."""
    return [dict(zip(FRAME, r, strict=True)) for r in _frames(content)]


def _frames(content: bytes) -> list[tuple]:
    """Like ``frames``, as tuples."""
    out, at, types = [], 0, []
    while at < len(content):
        rest, size, error, kind = len(content) - at, 0, None, None
        fielded = not out or content[at : at + 1].isdigit()
        if fielded:
            tag = _TAG.match(content, at)
            kind = int(tag[1]) if tag else None
            ends = [e for e in (content.find(b"\x1d", tag.end()), content.find(b"\x1c", tag.end())) if e >= 0] if tag else []
            if not tag:
                error = 1000
            elif int(tag[2]) != 1:
                error = 1004
            elif not ends:
                error = 1005
            elif not _INT.fullmatch(value := content[tag.end() : min(ends)]) or abs(int(value)) >= 1 << 31:
                error = 1006
            elif not 0 < (size := int(value)) <= rest:
                error, size = 1002, 0
            elif content[at + size - 1 : at + size] != b"\x1c":
                error, size = 1003, 0
            elif 0 < len(out) <= len(types) and types[len(out) - 1] not in (None, kind):
                error = 1001
        else:
            kind = types[len(out) - 1] if len(out) <= len(types) else None
            size = int.from_bytes(content[at : at + 4], "big", signed=True) if rest >= 4 else 0
            if not 0 < size <= rest:
                error, size = 1002 if rest >= 4 else 1007, 0
            error = 1012 if kind is None else error
        framed = content[at : at + (size or rest)]
        if not out and fielded and size and kind == 1:
            types, error = _announced(framed[:-1])
        out.append((kind, at, len(framed), fielded and size > 0, framed, error))
        at += len(framed)
    return out


def _framed(content: Column) -> Column:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32())

    def run(files: pa.Array) -> pa.Array:
        found = [[] if f is None else _frames(f) for f in files.to_pylist()]
        columns = list(zip(*(r for records in found for r in records), strict=True)) or [()] * len(FRAME)
        records = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], FRAME)
        ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
        return pa.ListArray.from_arrays(ends, records, mask=files.is_null())

    return F.arrow_udf(run, "array<struct<type:int,byte_offset:bigint,size:bigint,fielded:boolean,data:binary,error:int>>")(content)


def decode_files(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """One row per record: path, record_index, type, offset, size, fields, error and bytes.

    The first record and those that begin with a digit are fielded and end
    where their length field says, whatever their values hold. Others are
    binary: a 4-byte length, the type announced by the first record, no
    ``pieces``, the whole record in ``data`` (null for fielded ones).

    ``error``: 1000 no tag at the start of a record, or no content, 1001 a type
    other than the announced one, 1002 length beyond the file or not positive, 1003 no FS at the
    end, 1004 no length field first, 1005 length not ended, 1006 length no
    integer, 1007 binary length cut off, 1010 or 1011 bad announced type, 1012
    binary record that was not announced. A record without a frame takes the
    rest of the file into ``data`` and has no ``pieces``. An empty or null file is one row without a
    record, the null one with error 1000. A framed record starts with a tag, so it is never empty and each of
    its fields has one: there are no errors 1008 and 1009.
    """
    content = F.col(content_col).cast("binary")
    rows = files.select(F.col(path_col).alias("path"), content.isNull().alias("none"), F.posexplode_outer(_framed(content)).alias("record_index", "r"))
    body = F.decode(F.expr("substring(r.data, 1, r.size - 1)"), "ISO-8859-1")
    pieces = F.when(F.col("r.fielded"), nist.split_fields(body)).otherwise(F.array().cast("array<string>"))
    return rows.select("path", "record_index", "r.type", "r.byte_offset", "r.size", pieces.alias("pieces"), F.when(F.col("none"), 1000).otherwise(F.col("r.error")).alias("error"), F.when(~F.col("r.fielded"), F.col("r.data")).alias("data"))


def inspect_fields(fields: DataFrame) -> DataFrame:
    """path, record_index, field_index, tag, preview, ``n_subfields`` and ``n_items`` of every field."""
    value = F.col("value")
    return fields.select("path", "record_index", "field_index", nist.tag(F.col("record_type"), F.col("field_number")).alias("tag"), nist.preview(value).alias("preview"), nist.subfield_count(value).cast("long").alias("n_subfields"), nist.item_count(value).cast("long").alias("n_items"))


def inspect_files(records: DataFrame) -> DataFrame:
    """One row per file: ``record_count``, ``field_count``, ``opaque_count``, ``version`` (1.002), ``content`` (1.003) and the first error."""
    first = lambda tag: F.max(F.when(F.col("record_index") == 0, F.regexp_replace(F.get(F.filter("pieces", lambda p: F.startswith(p, F.lit(tag))), 0), f"^{tag}", "")))
    return records.groupBy("path").agg(F.count("record_index").alias("record_count"), F.sum(F.coalesce(F.size("pieces"), F.lit(0))).cast("long").alias("field_count"), F.count_if(F.col("data").isNotNull() & F.col("error").isNull()).alias("opaque_count"), first("1.002:").alias("version"), first("1.003:").alias("content"), F.min_by("error", F.when(F.col("error").isNotNull(), F.coalesce("record_index", F.lit(-1)))).alias("error"))


def encode_files(records: DataFrame) -> DataFrame:
    """path, content: the files of decoded records. Fielded ones get their lengths anew, binary ones are kept as they are.

    A file is put together in one row, as it was read.
    """
    at = lambda p: F.instr(p, ":")
    field = lambda p: nist.bound(nist.parse_tag(F.substring(p, F.lit(1), at(p) - 1)), lambda t: F.struct(t["record_type"].alias("record_type"), t["field_number"].alias("field_number"), F.substring(p, at(p) + 1, F.length(p)).alias("value")))
    encoded = F.coalesce(F.col("data"), F.when(F.size("pieces") > 0, nist.latin1(nist.bound(F.transform("pieces", field), encode_record))), F.lit(b""))
    held = records.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("record_index", encoded.alias("bytes")))).alias("records"))
    return held.select("path", F.aggregate("records", F.lit(b"").cast("binary"), lambda a, r: F.concat(a, r["bytes"])).alias("content"))


def find_records(records: DataFrame, record_type: int) -> DataFrame:
    """Records of one type, in the order of their files."""
    return records.where(F.col("type") == record_type)


def mixed_records(records: DataFrame) -> DataFrame:
    """path, record_index of the records that name several record types; the error of a file is never thrown."""
    return records.where(nist.mixed_types(F.col("pieces"))).select("path", "record_index")


def named_fields(fields: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Fields with ``label`` and ``mnemonic`` of a catalogue (record_type, field_number, label, mnemonic).

    A catalogue row without a record type holds for all types; fields in
    neither are called ``Field nnn``. The catalogue is a list of the standard
    and is broadcast below ``CATALOGUE`` rows.
    """
    small = catalogue.limit(CATALOGUE + 1).count() <= CATALOGUE
    held = F.broadcast(catalogue) if small else catalogue
    own = held.where("record_type is not null").select("record_type", "field_number", F.struct("label", "mnemonic").alias("own"))
    general = held.where("record_type is null").select("field_number", F.struct("label", "mnemonic").alias("general"))
    both = fields.join(own, ["record_type", "field_number"], "left").join(general, "field_number", "left")
    pick = lambda c: F.coalesce(F.col(f"own.{c}"), F.col(f"general.{c}"))
    return both.select(*fields.columns, F.coalesce(pick("label"), F.format_string("Field %03d", "field_number")).alias("label"), pick("mnemonic").alias("mnemonic"))


#: Rows up to which a field catalogue is broadcast.
CATALOGUE = 100_000


def fields_of(records: DataFrame) -> DataFrame:
    """One row per field: record_type, field_number and value."""
    each = records.select("path", "record_index", F.posexplode("pieces").alias("field_index", "piece"))
    at = F.instr("piece", ":")
    # Exploded as a list of one, so that a tag is parsed once and not again for every use of its numbers.
    each = each.select("*", F.explode(F.array(nist.parse_tag(F.substring("piece", F.lit(1), at - 1)))).alias("t"))
    return each.select("path", "record_index", "field_index", F.col("t.record_type").alias("record_type"), F.col("t.field_number").alias("field_number"), F.substring("piece", at + 1, F.length("piece")).alias("value"))


def expected_types(content: Column) -> Column:
    """Record types that a content field (1.003) announces, first entry left out."""
    subs = nist.subfields(content)
    return F.transform(F.slice(subs, 2, F.greatest(F.size(subs) - 1, F.lit(0))), lambda s: F.get(s, 0).try_cast("int"))


def content_mismatches(fields: DataFrame, records: DataFrame) -> DataFrame:
    """Announced types that the record in their place does not have; missing records pass."""
    told = fields.where("record_type = 1 and field_number = 3 and record_index = 0").select("path", F.posexplode(expected_types(F.col("value"))).alias("i", "expected"))
    have = records.select("path", (F.col("record_index") - 1).alias("i"), "type")
    return told.join(have, ["path", "i"]).where("expected is null or type <> expected").select("path", "i", "expected", "type")


def announced_mismatches(records: DataFrame) -> DataFrame:
    """Like ``content_mismatches``, from the records alone: the types of a file meet in one row."""
    content = F.regexp_replace(F.get(F.filter("pieces", lambda p: F.startswith(p, F.lit("1.003:"))), 0), "^1.003:", "")
    of = F.when((F.col("record_index") == 0) & (F.col("type") == 1), expected_types(content))
    types = F.array_sort(F.collect_list(F.struct("record_index", "type")))
    files = records.groupBy("path").agg(F.max(of).alias("expected"), types.alias("types"))
    places = F.transform("expected", lambda e, i: F.struct(i.alias("i"), e.alias("expected"), F.get("types", i + 1).alias("r")))
    each = files.select("path", F.inline(places)).where("r is not null").select("path", "i", "expected", F.col("r.type").alias("type"))
    return each.where("expected is null or type <> expected")
