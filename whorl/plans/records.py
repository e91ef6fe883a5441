"""Queries of record operators on files with binary records, faults and images, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images, nist
from ..operators import transactions
from ..operators.tiles import spread
from .bridges import FILE_COST, order_files


def _orders(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _field(record_type: int, number: int, value):
    return F.struct(F.lit(record_type).alias("record_type"), F.lit(number).alias("field_number"), value.alias("value"))


def _hex(value, size: int):
    return F.lpad(F.hex(value.cast("long")), 2 * size, "0")


def card_files(spark, sf_dir: str, mixed: bool = False) -> DataFrame:
    """A file per order: type 1, type 10 with an FS inside its image, and a binary type 4 record.

    Every seventh file announces type 14 for the second record; with ``mixed``
    every eleventh has a field of type 2 in it.
    """
    key = F.col("o_orderkey")
    content = F.concat(F.lit(f"1{nist.US}2{nist.RS}"), F.when(key % 7 == 0, "14").otherwise("10"), F.lit(f"{nist.US}01{nist.RS}4{nist.US}02"))
    first = transactions.encode_record(F.array(_field(1, 2, F.lit("0500")), _field(1, 3, content)))
    image = _field(10, 999, F.concat(F.lit("\xff\x1c"), F.col("o_orderpriority")))
    second = transactions.encode_record(F.array(_field(10, 2, F.lit("01")), image))
    if mixed:
        second = F.when(key % 11 == 0, transactions.encode_record(F.array(_field(10, 2, F.lit("01")), _field(2, 3, F.lit("x")), image))).otherwise(second)
    third = F.unhex(F.concat(_hex(F.lit(28), 4), _hex(key % 256, 1), F.lit("00"), _hex(key % 11, 1), F.lit("FFFFFFFFFF"), F.lit("01"), _hex(key % 65536, 2), _hex(F.lit(500), 2), F.lit("00"), F.lit("1C" * 10)))
    return spread(_orders(spark, sf_dir), "o_orderkey", FILE_COST).select(key.alias("path"), F.concat(nist.latin1(F.concat(first, second)), third).alias("content"))


def n3_binary(spark, sf_dir):
    found = transactions.decode_files(card_files(spark, sf_dir))
    return found.select("path", F.col("record_index").cast("long"), F.col("type").cast("long"), "byte_offset", "size", F.col("data").isNotNull().alias("is_binary"), F.coalesce("error", F.lit(0)).cast("long").alias("error"))


def n7_mismatches(spark, sf_dir):
    records = transactions.decode_files(card_files(spark, sf_dir))
    found = transactions.announced_mismatches(records)
    return found.select("path", F.col("i").cast("long"), F.col("expected").cast("long"), F.col("type").cast("long"))


def _first_record(content: str) -> str:
    """A record of type 1 with this content field and its right length."""
    rest = f"{nist.GS}1.002:0500{nist.GS}1.003:{content}{nist.FS}"
    size = next(n for n in range(1000) if n == 6 + len(str(n)) + len(rest))
    return f"1.001:{size}{rest}"


#: Content of each kind of file, the error in it and its number of records.
_NEXT = nist.RS.join(("1" + nist.US + "2", "10" + nist.US + "01", "4" + nist.US + "02"))
FAULTS = (
    (_first_record(_NEXT), 0, 1), (_first_record(_NEXT)[:-1], 1002, 1), (_first_record(_NEXT)[:-1] + "x", 1003, 1), (f"1.002:0500{nist.FS}", 1004, 1),
    (_first_record(_NEXT).replace("41", "4x", 1), 1006, 1), ("1.001:41", 1005, 1), ("no tag at all", 1000, 1), (_first_record(_NEXT) + "\x00\x00", 1007, 2), (f"{_first_record(_NEXT)}2.001:8{nist.FS}", 1001, 2),
    (_first_record(_NEXT + nist.RS), 1010, 1), (_first_record(f"1{nist.US}2{nist.RS}x{nist.US}01"), 1011, 1), (_first_record("1") + "\x00\x00\x00\x04", 1012, 2),
)


def n2_errors(spark, sf_dir):
    """Twelve kinds of files: a right one and eleven broken in one way each."""
    content = F.get(F.array(*(F.lit(kind) for kind, _, _ in FAULTS)), (F.col("o_orderkey") % len(FAULTS)).cast("int"))
    found = transactions.decode_files(_orders(spark, sf_dir).select(F.col("o_orderkey").alias("path"), nist.latin1(content).alias("content")))
    return found.groupBy("path").agg(F.coalesce(F.max("error"), F.lit(0)).cast("long").alias("error"), F.count("*").alias("n"))


def n5_mixed(spark, sf_dir):
    found = transactions.mixed_records(transactions.decode_files(card_files(spark, sf_dir, mixed=True)))
    return found.select("path", F.col("record_index").cast("long"))


def n12_records(spark, sf_dir):
    found = transactions.find_records(transactions.decode_files(card_files(spark, sf_dir)), 10)
    return found.select("path", "size")


def n13_fields(spark, sf_dir):
    records = transactions.decode_files(order_files(spark, sf_dir)).where("record_index = 0")
    held = transactions.fields_of(records).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("field_index", "record_type", "field_number", "value"))).alias("fields"))
    return held.select("path", nist.find_field(F.col("fields"), 4).alias("priority"), nist.find_field(F.col("fields"), 5, 1).alias("day"), nist.find_field(F.col("fields"), 77).alias("none"))


def n17_round_trip(spark, sf_dir):
    files = card_files(spark, sf_dir).union(order_files(spark, sf_dir).select(-F.col("path") - 1, "content"))
    digest = lambda df, name: df.select("path", F.sha2("content", 256).alias(name))
    back = digest(transactions.encode_files(transactions.decode_files(files)), "back")
    return digest(files, "digest").join(back, "path").agg(F.count("*").alias("n_files"), F.count_if(F.col("digest") == F.col("back")).alias("n_same"))


def n18_fields(spark, sf_dir):
    found = transactions.inspect_fields(transactions.fields_of(transactions.decode_files(order_files(spark, sf_dir))))
    return found.where("tag <> '1.001' and tag <> '2.001'").groupBy("tag").agg(F.count("*").alias("n"), F.sum("n_subfields").cast("long").alias("n_subfields"), F.sum("n_items").cast("long").alias("n_items"), F.max(F.length("preview")).cast("long").alias("longest"))


def n18_files(spark, sf_dir):
    found = transactions.inspect_files(transactions.decode_files(card_files(spark, sf_dir)))
    return found.select("path", "record_count", "field_count", "opaque_count", "version", nist.preview(F.col("content")).alias("content"), F.coalesce("error", F.lit(0)).cast("long").alias("error"))


def n19_labels(spark, sf_dir):
    catalogue = spark.createDataFrame([(None, 1, "Logical record length", "LEN"), (None, 2, "Information designation character", "IDC"), (1, 2, "Version number", "VER"), (1, 3, "File content", "CNT"), (1, 4, "Type of transaction", "TOT"), (1, 5, "Date", "DAT")], "record_type int, field_number int, label string, mnemonic string")
    found = transactions.named_fields(transactions.fields_of(transactions.decode_files(order_files(spark, sf_dir))), catalogue)
    return found.groupBy("record_type", "label", "mnemonic").agg(F.count("*").alias("n")).select(F.col("record_type").cast("long"), "label", "mnemonic", "n")


def n21_signature(spark, sf_dir):
    key = F.col("o_orderkey")
    head = nist.signature_header(F.unhex(F.concat(_hex(F.lit(20), 4), _hex(key % 256, 1), _hex(key % 3, 1), _hex(key % 2, 1), F.lit("01"), _hex(key % 65536, 2), _hex(F.lit(572), 2), F.lit("00" * 8))))
    return _orders(spark, sf_dir).select("o_orderkey", *(head[c].alias(c) for c in ("length", "idc", "sig", "srt", "isr", "hll", "vll", "payload")))


def n22_payload(spark, sf_dir):
    key = F.col("o_orderkey")
    kind, width, height = key % 6 + 3, key % 40, F.lit(8)
    payload = F.when(key % 5 == 0, F.ceil(width / 8) * height).when(key % 5 == 1, width * height).when(key % 5 == 2, 3 * width * height).otherwise(17)
    return _orders(spark, sf_dir).select("o_orderkey", nist.payload_class(kind, width, height, (key % 7) % 3, payload, payload + 18).alias("class"))


def n26_images(spark, sf_dir):
    fields = transactions.fields_of(transactions.decode_files(card_files(spark, sf_dir)))
    return fields.select("path", F.hex(nist.image_payload(F.col("record_type"), F.col("field_number"), F.col("value"))).alias("payload")).where("payload is not null")


def n23_embedded(spark, sf_dir):
    key = F.col("o_orderkey")
    marks = list(images.SIGNATURES.values())
    data = F.unhex(F.concat(F.repeat(F.lit("0F"), (key % 5).cast("int")), F.get(F.array(*map(F.lit, marks)), (key % len(marks)).cast("int")), F.lit("0F0F"), F.when(key % 2 == 0, "424D").otherwise("")))
    return _orders(spark, sf_dir).select("o_orderkey", F.coalesce(images.embedded_offset(data), F.lit(-1)).cast("long").alias("at"))


QUERIES = {f.__name__: f for f in (n2_errors, n3_binary, n5_mixed, n7_mismatches, n12_records, n13_fields, n17_round_trip, n18_fields, n18_files, n19_labels, n21_signature, n22_payload, n23_embedded, n26_images)}

_SIZE = "30 + length(o_orderpriority)"
_MARKS = list(images.SIGNATURES.values())
# Lengths of the signatures in the fixture, in its order.
_LENGTHS = ", ".join(str(len(m) // 2) for m in _MARKS)

ORACLES = {
    "n2_errors": f"select o_orderkey as path, cast({[e for _, e, _ in FAULTS]}[1 + o_orderkey % {len(FAULTS)}] as bigint) as error, cast({[n for _, _, n in FAULTS]}[1 + o_orderkey % {len(FAULTS)}] as bigint) as n from orders",
    "n3_binary": f"select o_orderkey as path, 0::bigint as record_index, 1::bigint as type, 0::bigint as byte_offset, 41::bigint as size, false as is_binary, 0::bigint as error from orders union all select o_orderkey, 1, 10, 41, {_SIZE}, false, case when o_orderkey % 7 = 0 then 1001 else 0 end from orders union all select o_orderkey, 2, 4, 41 + {_SIZE}, 28, true, 0 from orders",
    "n5_mixed": "select o_orderkey as path, 1::bigint as record_index from orders where o_orderkey % 11 = 0",
    "n7_mismatches": "select o_orderkey as path, 0::bigint as i, 14::bigint as expected, 10::bigint as type from orders where o_orderkey % 7 = 0",
    "n12_records": f"select o_orderkey as path, cast({_SIZE} as bigint) as size from orders",
    "n13_fields": "select o_orderkey as path, o_orderpriority as priority, strftime(o_orderdate, '%Y%m%d') as day, null::varchar as none from orders",
    "n17_round_trip": "select 2 * count(*) as n_files, 2 * count(*) as n_same from orders",
    "n18_fields": "with l as (select l_orderkey as k, l_returnflag || ' | ' || l_linestatus || ' / ' || l_quantity::integer as v from lineitem join orders on l_orderkey = o_orderkey), c as (select o_orderkey, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1), o as (select count(*) as o, max(length(o_orderpriority)) as p, max(length(o_orderkey::varchar)) as m from orders) select '1.002' as tag, o as n, o as n_subfields, o as n_items, 4::bigint as longest from o union all select '1.003', count(*), sum(1 + n)::bigint, sum(2 + 2 * n)::bigint, max(least(96, 4 + length(n::varchar) + 9 * n))::bigint from c union all select '1.004', o, o, o, p from o union all select '1.005', o, o, o, 8 from o union all select '1.009', o, o, o, m from o union all select '2.002', count(*), count(*), count(*), 2 from l union all select '2.003', count(*), 2 * count(*), 3 * count(*), max(length(v))::bigint from l",
    "n18_files": "select o_orderkey as path, 3::bigint as record_count, 6::bigint as field_count, 1::bigint as opaque_count, '0500' as version, '1 | 2 / ' || case when o_orderkey % 7 = 0 then '14' else '10' end || ' | 01 / 4 | 02' as content, (case when o_orderkey % 7 = 0 then 1001 else 0 end)::bigint as error from orders",
    "n19_labels": "with o as (select count(*) as n from orders), l as (select count(*) as n from lineitem join orders on l_orderkey = o_orderkey) select 1::bigint as record_type, a as label, b as mnemonic, n from o, (values ('Logical record length', 'LEN'), ('Version number', 'VER'), ('File content', 'CNT'), ('Type of transaction', 'TOT'), ('Date', 'DAT'), ('Field 009', null)) v(a, b) union all select 2, a, b, n from l, (values ('Logical record length', 'LEN'), ('Information designation character', 'IDC'), ('Field 003', null)) v(a, b)",
    "n21_signature": "select o_orderkey, 20::bigint as length, o_orderkey % 256 as idc, o_orderkey % 3 as sig, o_orderkey % 2 as srt, 1::bigint as isr, o_orderkey % 65536 as hll, 572::bigint as vll, 8::bigint as payload from orders",
    "n22_payload": "with v as (select o_orderkey, o_orderkey % 6 + 3 as t, o_orderkey % 40 as w, (o_orderkey % 7) % 3 as c, o_orderkey % 5 as s from orders), p as (select *, case s when 0 then (w + 7) // 8 * 8 when 1 then 8 * w when 2 then 24 * w else 17 end as n from v) select o_orderkey, case when w = 0 then 'unsupported' when t = 8 then case when n = (w + 7) // 8 * 8 then 'bitonal' when n = 8 * w then 'gray' when n = 24 * w then 'rgb' else 'unsupported' end when c = 0 and t in (5, 6) and n = (w + 7) // 8 * 8 then 'bitonal' when c = 0 and t in (3, 4, 7) and n = 8 * w then 'gray' when c = 1 and t in (3, 4, 7) then 'wsq' else 'unsupported' end as class from p",
    "n23_embedded": f"select o_orderkey, cast(case when o_orderkey % 5 > 0 then o_orderkey % 5 when o_orderkey % 2 = 0 then [{_LENGTHS}][1 + o_orderkey % {len(_MARKS)}] + 2 else -1 end as bigint) as at from orders",
    "n26_images": "select o_orderkey as path, 'FF1C' || hex(o_orderpriority) as payload from orders",
}
