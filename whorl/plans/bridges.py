"""Queries over the driver's tables in the shapes of the operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import images, nist
from ..operators import reports, transactions
from ..operators.tiles import tasks


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Made rows that cost as much as the records of one order.
FILE_COST = 100


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order: a type 1 record and a type 2 record per line.

    Orders have few bytes and much work, so their number sets the tasks, not their size.
    """
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    value = F.concat(F.col("l_returnflag"), F.lit(nist.US), F.col("l_linestatus"), F.lit(nist.RS), F.col("l_quantity").cast("int").cast("string"))
    n = tasks(orders, FILE_COST)
    held = lines.select(F.col("l_orderkey").alias("o_orderkey"), value.alias("value")).repartition(n, "o_orderkey").groupBy("o_orderkey").agg(F.array_sort(F.collect_list("value")).alias("lines"))
    df = orders.repartition(n, "o_orderkey").join(held.hint("merge"), "o_orderkey", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    field = lambda t, n, v: F.struct(F.lit(t).alias("record_type"), F.lit(n).alias("field_number"), v.alias("value"))
    index = lambda i: F.lpad((i + 1).cast("string"), 2, "0")
    count = F.concat(F.lit(f"1{nist.US}"), F.size("lines").cast("string"), F.array_join(F.transform("lines", lambda _, i: F.concat(F.lit(f"{nist.RS}2{nist.US}"), index(i))), ""))
    first = transactions.encode_record(F.array(field(1, 2, F.lit("0500")), field(1, 3, count), field(1, 4, F.col("o_orderpriority")), field(1, 5, F.date_format("o_orderdate", "yyyyMMdd")), field(1, 9, F.col("o_orderkey").cast("string"))))
    second = F.array_join(F.transform("lines", lambda v, i: transactions.encode_record(F.array(field(2, 2, index(i)), field(2, 3, v)))), "")
    return df.select(F.col("o_orderkey").alias("path"), nist.latin1(F.concat(first, second)).alias("content"))


def s2_encode(spark, sf_dir):
    return order_files(spark, sf_dir).select("path", F.octet_length("content").cast("long").alias("n_bytes"))


def n1_records(spark, sf_dir):
    found = transactions.decode_files(order_files(spark, sf_dir))
    return found.groupBy("type").agg(F.count("*").alias("n_records"), F.sum("size").cast("long").alias("n_bytes"), F.count("error").alias("n_errors"))


def n4_fields(spark, sf_dir):
    found = transactions.fields_of(transactions.decode_files(order_files(spark, sf_dir)))
    return found.groupBy(nist.tag(F.col("record_type"), F.col("field_number")).alias("tag")).agg(F.count("*").alias("n_fields"), F.sum(nist.item_count(F.col("value"))).cast("long").alias("n_items")).where("tag not like '%.001'")


def n7_content_check(spark, sf_dir):
    records = transactions.decode_files(order_files(spark, sf_dir))
    return transactions.announced_mismatches(records).agg(F.count("*").alias("n_mismatches"))


def n8_subfields(spark, sf_dir):
    value = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(nist.US)), F.lit("\n"), F.lit(nist.RS))
    back = nist.field_value(nist.subfields(value))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(nist.subfields(value)).cast("long").alias("n_subfields"), nist.item_count(value).cast("long").alias("n_items"), (back == value).alias("round_trip"))


def n11_tags(spark, sf_dir):
    tag = nist.tag((F.col("o_orderkey") % 100).cast("int"), (F.col("o_custkey") % 1000).cast("int"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", tag.alias("tag"), nist.parse_tag(tag)["field_number"].cast("long").alias("field_number"))


def n18_inspection(spark, sf_dir):
    found = transactions.decode_files(order_files(spark, sf_dir))
    return found.groupBy("path").agg(F.count("*").alias("record_count"), F.max("byte_offset").cast("long").alias("last_offset"), F.sum(F.size("pieces")).cast("long").alias("field_count"))


def n20_binary_header(spark, sf_dir):
    key = F.col("o_orderkey")
    hexes = lambda v, n: F.lpad(F.hex(v.cast("long")), 2 * n, "0")
    data = F.unhex(F.concat(hexes(F.lit(28), 4), hexes(key % 256, 1), hexes(key % 4, 1), hexes(key % 11, 1), F.lit("FFFFFFFFFF"), hexes(key % 2, 1), hexes(key % 65536, 2), hexes(F.lit(500), 2), hexes(key % 3, 1), F.lit("00" * 10)))
    head = nist.binary_header(data)
    return _table(spark, sf_dir, "orders").select("o_orderkey", head["length"].alias("length"), head["idc"].alias("idc"), F.size(head["fgp"]).cast("long").alias("n_fgp"), head["hll"].alias("hll"), head["vll"].alias("vll"), head["payload"].alias("payload"))


def n25_preview(spark, sf_dir):
    key = F.col("o_orderkey")
    value = F.concat(F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit(nist.US)), F.when(key % 3 == 0, F.repeat(F.lit("x"), (key % 120).cast("int"))).when(key % 3 == 1, F.lit("\x00")).otherwise(""))
    return _table(spark, sf_dir, "orders").select("o_orderkey", nist.preview(value).alias("preview"), nist.is_binary_like(value).alias("binary_like"))


def q_histogram(spark, sf_dir):
    return reports.histogram(_table(spark, sf_dir, "lineitem"), "l_partkey", "l_discount", [0.01, 0.03, 0.05, 0.07, 0.09])


def c_report_difference(spark, sf_dir):
    parts = _table(spark, sf_dir, "part")
    wide = parts.select(F.concat(F.lit("a/"), F.col("p_partkey").cast("string")).alias("filename"), F.col("p_size").cast("string").alias("size"), (F.col("p_partkey") % 7).cast("string").alias("score"))
    key = F.col("p_partkey")
    other = parts.where(key % 101 != 0).select(F.concat(F.lit("b/"), key.cast("string")).alias("filename"), F.col("p_size").cast("string").alias("size"), F.when(key % 17 == 0, "x").otherwise((key % 7).cast("string")).alias("score"))
    return reports.compare(wide, other, ["size", "score"], "filename")


def n23_image_format(spark, sf_dir):
    key = F.col("p_partkey")
    marks = F.array(*(F.lit(m) for m in images.SIGNATURES.values()), F.lit("00"))
    data = F.unhex(F.concat(F.get(marks, (key % (len(images.SIGNATURES) + 1)).cast("int")), F.lit("00FF" * 8)))
    return _table(spark, sf_dir, "part").select("p_partkey", images.image_format(data).alias("format"))


def n27_routing(spark, sf_dir):
    ending = F.get(F.array(*map(F.lit, ("AN2", "nist", "wsq", "png", "Eft"))), (F.col("p_partkey") % 5).cast("int"))
    return _table(spark, sf_dir, "part").groupBy(images.route(F.concat(F.lit("in/a."), ending)).alias("kind")).agg(F.count("*").alias("n"))


def w4_ppi(spark, sf_dir):
    key = F.col("p_partkey")
    text = F.concat(F.when(key % 7 == 0, "other").otherwise("NIST_COM 9"), F.lit("\n  PIX_WIDTH\t"), F.col("p_size").cast("string"), F.when(key % 3 == 0, "\r\nPPI -1\nPPI \n").when(key % 3 == 1, F.concat(F.lit("\nPPI 9\n PPI\t"), (key % 1000).cast("string"), F.lit(" "))).otherwise("\nPPI x"))
    return _table(spark, sf_dir, "part").select("p_partkey", images.ppi(text).cast("long").alias("ppi"), images.comment_value(text, "PIX_WIDTH").alias("width"))


def _coefficients(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))).alias("i"))
    i = F.col("i") + F.col("p_partkey")
    return parts.withColumn("c", F.when(i % 5 < 3, 0).otherwise(i * i % 401 - 200).cast("double"))


def w23_quantize(spark, sf_dir):
    return _coefficients(spark, sf_dir).select("p_partkey", "i", images.quantize(F.col("c"), F.lit(8.0), F.lit(10.0)).alias("q"))


def w14_unquantize(spark, sf_dir):
    q = images.quantize(F.col("c"), F.lit(8.0), F.lit(10.0))
    return _coefficients(spark, sf_dir).select("p_partkey", "i", F.round(images.unquantize(q, F.lit(8.0), F.lit(10.0)), 6).alias("c"))


def w16_pixels(spark, sf_dir):
    return _coefficients(spark, sf_dir).select("p_partkey", "i", images.to_pixel(F.col("c"), F.lit(1.5), F.lit(128.0)).alias("v"))


def _trees() -> list[dict]:
    leaf = lambda c: {"class": c}
    split = lambda f, t, a, b: {"feature": f, "threshold": t, "left": a, "right": b}
    return [split("size", 10.0 + 5 * i, split("price", 1000.0 + 50 * i, leaf(0), leaf(1)), split("price", 1200.0, leaf(1), leaf(0))) for i in range(5)]


def _measures(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.col("p_size").cast("double").alias("size"), F.floor("p_retailprice").cast("double").alias("price"))


def q_forest_score(spark, sf_dir):
    return reports.forest_votes(_measures(spark, sf_dir), _trees())


def q_measures_long(spark, sf_dir):
    return reports.long_measures(_measures(spark, sf_dir), "image_id", ["size", "price"])


def q_measures_wide(spark, sf_dir):
    return reports.wide_measures(q_measures_long(spark, sf_dir), ["size", "price"])


def s15_json(spark, sf_dir):
    row = F.struct(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"), F.col("p_brand").alias("brand"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def s11_model_info(spark, sf_dir):
    text = F.concat(F.lit("Name = m"), F.col("p_partkey").cast("string"), F.lit("\n\nbad line\nPath=a=b\nHash = "), F.col("p_brand"))
    line = F.explode(F.split(text, "\n")).alias("line")
    at = F.instr("line", "=")
    return _table(spark, sf_dir, "part").select("p_partkey", line).where(at > 1).select("p_partkey", F.trim(F.substring("line", F.lit(1), at - 1)).alias("key"), F.trim(F.substring("line", at + 1, F.length("line"))).alias("value"))


def w18_normalize(spark, sf_dir):
    return _coefficients(spark, sf_dir).groupBy("p_partkey").agg(F.round(F.avg("c"), 6).alias("shift"), F.round(F.greatest(F.avg("c") - F.min("c"), F.max("c") - F.avg("c")) / 128, 6).alias("scale"))


def w20_variance(spark, sf_dir):
    return _coefficients(spark, sf_dir).groupBy("p_partkey").agg(F.round(F.var_samp("c"), 6).alias("variance"))


def w25_zero_runs(spark, sf_dir):
    """Lengths of the runs of zero coefficients, by gaps and islands."""
    runs = _coefficients(spark, sf_dir).withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("p_partkey", F.col("c") == 0).orderBy("i"))).where("c = 0").groupBy("p_partkey", "island").agg(F.count("*").alias("run"))
    return runs.groupBy("run").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (s2_encode, n1_records, n4_fields, n7_content_check, n8_subfields, n11_tags, n18_inspection, n20_binary_header, n25_preview, n23_image_format, n27_routing, w4_ppi, w23_quantize, w14_unquantize, w16_pixels, w18_normalize, w20_variance, w25_zero_runs, s11_model_info, s15_json, q_forest_score, q_measures_long, q_measures_wide, q_histogram, c_report_difference)}

# Sizes by arithmetic on the base tables only.
_SIZES = """
lines as (select l_orderkey, l_returnflag || '_' || l_linestatus || '_' || cast(cast(l_quantity as integer) as varchar) as v from lineitem),
seconds as (select l_orderkey, 6 + (7 + 2) + (7 + length(v)) + 1 as rest from lines),
second as (select l_orderkey, rest + case when rest + 2 < 100 then 2 else 3 end as size from seconds),
per as (select l_orderkey, count(*) as n, sum(size) as bytes from second group by 1),
firsts as (select o_orderkey, coalesce(n, 0) as n, coalesce(bytes, 0) as bytes, 6 + (7 + 4) + (7 + 2 + length(cast(coalesce(n, 0) as varchar)) + 5 * coalesce(n, 0)) + (7 + length(o_orderpriority)) + (7 + 8) + (7 + length(cast(o_orderkey as varchar))) + 1 as rest from orders left join per on l_orderkey = o_orderkey),
files as (select o_orderkey, n, bytes, rest + case when rest + 2 < 100 then 2 else 3 end as size from firsts)"""

_C = "with x as (select p_partkey, unnest(range(0, 200)) as i from part), c as (select p_partkey, i, cast(case when (i + p_partkey) % 5 < 3 then 0 else (i + p_partkey) * (i + p_partkey) % 401 - 200 end as double) as c from x)"
_Q = "cast(case when abs(c) <= 5 then 0 when c > 0 then trunc((c - 5) / 8 + 1) else trunc((c + 5) / 8 - 1) end as bigint)"

ORACLES = {
    "s2_encode": f"with {_SIZES} select o_orderkey as path, cast(size + bytes as bigint) as n_bytes from files",
    "n1_records": f"with {_SIZES} select 1 as type, count(*) as n_records, cast(sum(size) as bigint) as n_bytes, 0::bigint as n_errors from files union all select 2, count(*), cast(sum(size) as bigint), 0::bigint from second join orders on l_orderkey = o_orderkey",
    "n4_fields": "with n as (select count(*) as o from orders), l as (select count(*) as k from lineitem join orders on l_orderkey = o_orderkey) select '1.002' as tag, o as n_fields, cast(o as bigint) as n_items from n union all select '1.003', o, cast(2 * o + 2 * k as bigint) from n, l union all select '1.004', o, cast(o as bigint) from n union all select '1.005', o, cast(o as bigint) from n union all select '1.009', o, cast(o as bigint) from n union all select '2.002', k, cast(k as bigint) from l union all select '2.003', k, cast(3 * k as bigint) from l",
    "n7_content_check": "select 0::bigint as n_mismatches",
    "n8_subfields": "select doc_id, cast(1 + length(text) - length(replace(text, chr(10), '')) as bigint) as n_subfields, cast(1 + 2 * length(text) - length(replace(text, chr(10), '')) - length(replace(text, ' ', '')) as bigint) as n_items, true as round_trip from documents",
    "n11_tags": "select o_orderkey, cast(o_orderkey % 100 as varchar) || '.' || lpad(cast(o_custkey % 1000 as varchar), 3, '0') as tag, cast(o_custkey % 1000 as bigint) as field_number from orders",
    "n18_inspection": f"with {_SIZES}, lasts as (select l_orderkey, arg_max(size, v) as last from (select second.l_orderkey, lines.v, 24 + length(lines.v) - 1 as x, 23 + length(lines.v) + case when 25 + length(lines.v) < 100 then 2 else 3 end as size from lines join (select distinct l_orderkey from second) second using (l_orderkey)) group by 1) select o_orderkey as path, 1 + n as record_count, cast(case when n = 0 then 0 else size + bytes - last end as bigint) as last_offset, cast(6 + 3 * n as bigint) as field_count from files left join lasts on l_orderkey = o_orderkey",
    "n20_binary_header": "select o_orderkey, 28::bigint as length, cast(o_orderkey % 256 as bigint) as idc, cast(case when o_orderkey % 11 = 0 then 0 else 1 end as bigint) as n_fgp, cast(o_orderkey % 65536 as bigint) as hll, 500::bigint as vll, 10::bigint as payload from orders",
    "n25_preview": "with v as (select o_orderkey, replace(o_orderpriority, '-', ' | ') || case o_orderkey % 3 when 0 then repeat('x', o_orderkey % 120) when 1 then chr(0) else '' end as p from orders) select o_orderkey, case when length(p) > 96 then left(p, 95) || '…' else p end as preview, o_orderkey % 3 = 1 as binary_like from v",
    "q_histogram": "select l_partkey as image_id, cast(case when l_discount < 0.01 then 0 when l_discount < 0.03 then 1 when l_discount < 0.05 then 2 when l_discount < 0.07 then 3 when l_discount < 0.09 then 4 else 5 end as bigint) as bin, count(*) as n from lineitem group by 1, 2",
    "c_report_difference": "with p as (select cast(p_partkey as varchar) as k, p_partkey, cast(p_size as varchar) as size, cast(p_partkey % 7 as varchar) as score from part) select k as filename, 'filename' as \"column\", k as expected, null as actual from p where p_partkey % 101 = 0 union all select '*', '__metadata__', count(*)::varchar, (count(*) filter (where p_partkey % 101 <> 0))::varchar from p having count(*) filter (where p_partkey % 101 = 0) > 0 union all select k, 'score', score, 'x' from p where p_partkey % 17 = 0 and p_partkey % 101 <> 0",
    "n23_image_format": "select p_partkey, [" + ", ".join(f"'{k}'" for k in images.SIGNATURES) + f"][1 + p_partkey % {len(images.SIGNATURES) + 1}] as format from part",
    "n27_routing": "select case when p_partkey % 5 in (0, 1, 4) then 'transaction' else 'image' end as kind, count(*) as n from part group by 1",
    "w4_ppi": "select p_partkey, cast(case when p_partkey % 7 = 0 then 500 when p_partkey % 3 = 0 then -1 when p_partkey % 3 = 1 then p_partkey % 1000 else 500 end as bigint) as ppi, case when p_partkey % 7 <> 0 then cast(p_size as varchar) end as width from part",
    "w23_quantize": f"{_C} select p_partkey, i, {_Q} as q from c",
    "w14_unquantize": f"{_C}, q as (select p_partkey, i, {_Q} as q from c) select p_partkey, i, round(case when q = 0 then 0.0 when q > 0 then 8 * (q - 0.44::double) + 5 else 8 * (q + 0.44::double) - 5 end::double, 6) as c from q",
    "w16_pixels": f"{_C} select p_partkey, i, cast(least(greatest(floor(c * 1.5::double + 128.5), 0), 255) as bigint) as v from c",
    "w18_normalize": f"{_C} select p_partkey, round(avg(c), 6) as shift, round(greatest(avg(c) - min(c), max(c) - avg(c)) / 128, 6) as scale from c group by 1",
    "w20_variance": f"{_C} select p_partkey, round(var_samp(c), 6) as variance from c group by 1",
    "w25_zero_runs": f"{_C}, z as (select *, i - row_number() over (partition by p_partkey, c = 0 order by i) as island from c), r as (select count(*) as run from z where c = 0 group by p_partkey, island) select run, count(*) as n from r group by 1",
    "s11_model_info": "select p_partkey, 'Name' as key, 'm' || p_partkey as value from part union all select p_partkey, 'Path', 'a=b' from part union all select p_partkey, 'Hash', p_brand from part",
    "s15_json": "select p_partkey, '{\"id\":' || p_partkey || ',\"size\":' || case when p_size > 25 then cast(p_size as varchar) else 'null' end || ',\"brand\":\"' || p_brand || '\"}' as json from part",
    "q_forest_score": "with t as (select p_partkey, sum(case when p_size <= 10 + 5 * i then case when floor(p_retailprice) <= 1000 + 50 * i then 0 else 1 end else case when floor(p_retailprice) <= 1200 then 1 else 0 end end) as v from part, range(5) r(i) group by 1) select p_partkey as image_id, cast(v as bigint) as votes, cast(floor(v / 5.0 * 100 + 0.5) as bigint) as score from t",
    "q_measures_long": "select p_partkey as image_id, 'size' as name, cast(p_size as double) as value from part union all select p_partkey, 'price', cast(floor(p_retailprice) as double) from part",
    "q_measures_wide": "select p_partkey as image_id, cast(p_size as double) as size, cast(floor(p_retailprice) as double) as price from part",
}
