"""Column functions for transaction fields: tags, subfields, items, previews.

All are Spark SQL expressions, so Catalyst plans and prunes them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators of the transaction format.
FS, GS, RS, US = "\x1c", "\x1d", "\x1e", "\x1f"
# Record types whose field 999 is an image.
IMAGE_TYPES = (10, 13, 14, 15, 16, 17)
#: Largest pixels and bytes that are shown.
SHOWN_PIXELS, SHOWN_BYTES = 4_000_000, 12 << 20


def bound(value: Column, body) -> Column:
    """Evaluates ``value`` once and gives it to ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def subfields(value: Column) -> Column:
    """Array of subfields, each an array of items; empty parts are kept."""
    return F.transform(F.split(value, RS, -1), lambda s: F.split(s, US, -1))


def field_value(items: Column) -> Column:
    """Inverse of ``subfields``; null items become empty."""
    return F.array_join(F.transform(items, lambda s: F.array_join(s, US, "")), RS, "")


def subfield_count(value: Column) -> Column:
    return F.size(F.split(value, RS, -1))


def item_count(value: Column) -> Column:
    """One more than separators of both kinds, as every one of them begins an item."""
    return F.length(value) - F.length(F.replace(F.replace(value, F.lit(RS), F.lit("")), F.lit(US), F.lit(""))) + 1


def tag(record_type: Column, field_number: Column) -> Column:
    # A pattern is parsed for each row, so the usual numbers go without one.
    usual = record_type.isNotNull() & field_number.between(0, 999)
    return F.when(usual, F.concat(record_type.cast("string"), F.lit("."), F.lpad(field_number.cast("string"), 3, "0"))).otherwise(F.format_string("%d.%03d", record_type, field_number))


def parse_tag(text: Column) -> Column:
    """Struct (record_type, field_number), or null if the tag is malformed."""
    record_type = F.substring_index(text, ".", 1).try_cast("int")
    parts = F.struct(record_type.alias("record_type"), F.substring_index(text, ".", -1).try_cast("int").alias("field_number"))
    return F.when(text.rlike(r"^[0-9]+\.[0-9]{3}$") & record_type.isNotNull(), parts)


def split_fields(body: Column) -> Column:
    """Array of ``tag:value`` strings of a fielded record without its final FS.

    A group separator splits only where a tag follows; any other one belongs
    to the value.
    """
    return F.split(body, GS + r"(?=[0-9]+\.[0-9]{3}:)", -1)


def latin1(text: Column) -> Column:
    """Bytes of a text; characters beyond Latin-1 become question marks."""
    other = lambda t: F.encode(F.regexp_replace(t, r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    return bound(text, lambda t: F.when(F.octet_length(t) == F.length(t), t.cast("binary")).otherwise(other(t)))


def record_length(rest: Column, times: Column | int = 1) -> Column:
    """Smallest length that counts its own digits wherever it stands (``times``): ``rest`` is all but these digits."""
    out = None
    for digits in range(8, 0, -1):
        total = rest + digits * times
        fits = F.length(total.cast("string")) == digits
        out = F.when(fits, total) if out is None else F.when(fits, total).otherwise(out)
    return out


def is_binary_like(value: Column, image: Column | None = None) -> Column:
    """Control characters other than TAB, LF, CR, RS and US, or a field that holds an image."""
    found = value.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1D]")
    return found if image is None else F.coalesce(image, F.lit(False)) | found


def image_field(record_type: Column, field_number: Column, value: Column) -> Column:
    """Whether a field carries an image: field 999 of an image record, or a binary-like 999."""
    return (field_number == 999) & (record_type.isin(*IMAGE_TYPES) | is_binary_like(value))


def image_payload(record_type: Column, field_number: Column, value: Column) -> Column:
    """Bytes of an image field, null for others; characters keep their low eight bits."""
    return F.when(image_field(record_type, field_number, value), latin1(value))


def find_field(fields: Column, number: int, record_type: int | None = None) -> Column:
    """Value of the first field with a number (and type) in an array of (record_type, field_number, value), or null."""
    same = lambda f: (f["field_number"] == number) & (F.lit(True) if record_type is None else f["record_type"] == record_type)
    return F.get(F.filter(fields, same), 0)["value"]


def mixed_types(pieces: Column) -> Column:
    """Whether a record's ``tag:value`` strings name another record type than the first one."""
    types = F.transform(pieces, lambda p: F.regexp_extract(p, r"^([0-9]+)\.", 1))
    return F.exists(types, lambda t: t != F.get(types, 0))


def preview(value: Column, width: int = 96) -> Column:
    """One readable line: separators spelled out, blanks joined, cut with an ellipsis."""
    line = F.trim(F.regexp_replace(F.replace(F.replace(value, F.lit(US), F.lit(" | ")), F.lit(RS), F.lit(" / ")), r"\s+", " "))
    return F.when(line == "", "(empty)").when(F.length(line) > width, F.concat(F.substring(line, 1, max(0, width - 1)), F.lit("…"))).otherwise(line)


def big_endian(data: Column, start: int, size: int) -> Column:
    """Unsigned integer of ``size`` bytes from the 1-based place ``start``."""
    return F.conv(F.hex(F.substring(data, start, size)), 16, 10).cast("long")


def binary_header(data: Column) -> Column:
    """Header of record types 3 to 7, or null below 18 bytes."""
    byte = lambda i: big_endian(data, i, 1)
    fingers = F.filter(F.array(*(byte(i) for i in range(7, 13))), lambda b: ~b.isin(0, 255))
    return F.when(F.octet_length(data) >= 18, F.struct(big_endian(data, 1, 4).alias("length"), byte(5).alias("idc"), byte(6).alias("imp"), fingers.alias("fgp"), byte(13).alias("isr"), big_endian(data, 14, 2).alias("hll"), big_endian(data, 16, 2).alias("vll"), byte(18).alias("cga"), (F.octet_length(data) - 18).cast("long").alias("payload")))


def signature_header(data: Column) -> Column:
    """Header of record type 8, or null below 12 bytes."""
    byte = lambda i: big_endian(data, i, 1)
    return F.when(F.octet_length(data) >= 12, F.struct(big_endian(data, 1, 4).alias("length"), byte(5).alias("idc"), byte(6).alias("sig"), byte(7).alias("srt"), byte(8).alias("isr"), big_endian(data, 9, 2).alias("hll"), big_endian(data, 11, 2).alias("vll"), (F.octet_length(data) - 12).cast("long").alias("payload")))


def payload_class(record_type: Column, width: Column, height: Column, code: Column, payload: Column, size: Column) -> Column:
    """What the payload of a binary record holds: bitonal, gray, rgb, wsq or unsupported.

    Type 8 goes by exact length; types 5 and 6 are bitonal, others gray with
    code 0 at the exact length; code 1 of types 3, 4 and 7 is wsq. Records or images over the limits are unsupported.
    """
    pixels, bitonal = width * height, F.ceil(width / 8) * height
    signature = F.when(payload == bitonal, "bitonal").when(payload == pixels, "gray").when(payload == 3 * pixels, "rgb")
    print_ = F.when((code == 0) & record_type.isin(5, 6) & (payload == bitonal), "bitonal").when((code == 0) & record_type.isin(3, 4, 7) & (payload == pixels), "gray").when((code == 1) & record_type.isin(3, 4, 7), "wsq")
    fits = (width > 0) & (height > 0) & (pixels <= SHOWN_PIXELS) & (size <= SHOWN_BYTES)
    return F.coalesce(F.when(fits, F.when(record_type == 8, signature).when(record_type.between(3, 7), print_)), F.lit("unsupported"))
