"""Column functions for image payloads and wavelet coefficients."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes of the image formats, as hexadecimal text.
SIGNATURES = {"png": "89504E47", "jpeg": "FFD8FF", "gif": "474946", "bmp": "424D", "wsq": "FFA0FFA8", "j2k": "FF4FFF51", "jp2": "0000000C6A502020", "tiff-le": "49492A00", "tiff-be": "4D4D002A"}
# File endings of transaction files.
TRANSACTION_ENDINGS = ("nist", "nst", "an2", "eft")
#: Resolution where none is stated.
PPI = 500


def image_format(data: Column) -> Column:
    """Format by leading bytes, or null; below four bytes (jp2 and webp: twelve) there is none."""
    head, size = F.hex(F.substring(data, 1, 12)), F.octet_length(data)
    found = F.when((size >= 12) & F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "webp")
    for name, mark in SIGNATURES.items():
        found = found.when((size >= (12 if name == "jp2" else 4)) & F.startswith(head, F.lit(mark)), name)
    return found


def embedded_offset(data: Column) -> Column:
    """First offset from 1 on at which a signature begins, or null; webp has none of its own."""
    rest = F.decode(F.substring(data, 2, 2**31 - 1), "ISO-8859-1")
    found = [F.nullif(F.instr(rest, bytes.fromhex(mark).decode("latin-1")), F.lit(0)) for mark in SIGNATURES.values()]
    return F.least(*found)


def route(path: Column) -> Column:
    """``transaction`` or ``image``, by the path's ending."""
    ending = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(ending.isin(*TRANSACTION_ENDINGS), "transaction").otherwise("image")


def comment_fields(text: Column) -> Column:
    """Array of (key, value) of the lines of a NIST_COM comment, in order.

    Lines are trimmed; a key ends at the first blank or tab; lines without a
    value are left out.
    """
    lines = F.filter(F.transform(F.split(text, r"[\r\n]+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.rlike(r"^[^ \t]+[ \t]+\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([^ \t]+)", 1).alias("key"), F.regexp_extract(x, r"^[^ \t]+\s+(.*)$", 1).alias("value")))
    return F.when(F.startswith(text, F.lit("NIST_COM")), pairs).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def comment_value(text: Column, key: str) -> Column:
    """Value of a key; the last of equal keys wins."""
    return value_in(comment_fields(text), key)


def value_in(fields: Column, key: str) -> Column:
    """``comment_value`` of fields that are there already."""
    return F.try_element_at(F.filter(fields, lambda p: p["key"] == key), F.lit(-1))["value"]


def ppi(text: Column, default: int = PPI) -> Column:
    return F.coalesce(comment_value(text, "PPI").try_cast("int"), F.lit(default))


def ppi_of(comments: Column, default: int = PPI) -> Column:
    """Resolution of the first of several comments that states one as a whole number."""
    stated = F.filter(F.transform(comments, lambda text: comment_value(text, "PPI").try_cast("int")), lambda v: v.isNotNull())
    return F.coalesce(F.get(stated, 0), F.lit(default))


def quantize(c: Column, bin_: Column, zero: Column) -> Column:
    """Index of a coefficient: 0 inside the zero bin, else truncated towards it."""
    part = lambda v: F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("long")
    half = zero / 2
    return F.when(F.abs(c) <= half, F.lit(0).cast("long")).when(c > 0, part((c - half) / bin_ + 1)).otherwise(part((c + half) / bin_ - 1))


def unquantize(q: Column, bin_: Column, zero: Column, center: float = 0.44) -> Column:
    return F.when(q == 0, 0.0).when(q > 0, bin_ * (q - center) + zero / 2).otherwise(bin_ * (q + center) - zero / 2)


def to_pixel(v: Column, scale: Column, shift: Column) -> Column:
    return F.least(F.greatest(F.floor(v * scale + shift + 0.5), F.lit(0)), F.lit(255)).cast("long")
