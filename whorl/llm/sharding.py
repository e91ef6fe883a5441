"""Sharding by extendible hashing (DataFrame functions only).

A row's hash is the hexadecimal MD5 of its id followed by that of its text. The
directory is indexed by the hash's leading bits. Each round looks at the next
``BITS`` bits of the rows still in an oversized bucket: one histogram of bytes
(at most 2^BITS rows per bucket) gives the bytes of every bucket at every depth
of the round, and a row goes to the shallowest bucket that fits. Only buckets
over the limit at the round's last depth are read again. Rows that are equal in
all bits (copies of a row) cannot be split by hash; they are dealt to numbered
overflow pages, as many per page as fit.

Defined results: a null id or text hashes as empty; a row larger than the limit
gets a shard of its own; an empty table has no shards; repeated rows are kept;
other columns are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, Scratch

BITS = 12
LIMIT = 1 << 20
_DIGITS = BITS // 4


def shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``depth`` and ``shard`` (text, unique per shard)."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.md5(text.cast("binary")))
    rows = scratch.save(docs.select(F.col(id_col).alias(f"{OWN}id"), key.alias("hash"), F.octet_length(text).cast("long").alias("n_bytes")), "rows")
    placed, turn = [], 0
    while True:
        done = turn * _DIGITS
        leaf, base = F.substring("hash", 1, done + _DIGITS), F.substring("hash", 1, done)
        cells = rows.groupBy(leaf.alias("leaf")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        local = F.conv(F.substring("leaf", done + 1, _DIGITS), 16, 10).cast("int")
        first = 0 if not turn else 1  # depth 0 of a later round is the last of the one before
        depths = cells.select("*", F.explode(F.sequence(F.lit(first), F.lit(BITS))).alias("x")).withColumn("bucket", F.floor(local / F.pow(F.lit(2), BITS - F.col("x"))).cast("int"))
        bucket = Window.partitionBy(F.substring("leaf", 1, done), "x", "bucket")
        depths = depths.withColumns({"all_bytes": F.sum("bytes").over(bucket), "all_rows": F.sum("rows").over(bucket)})
        fits = (F.col("all_bytes") <= limit) | (F.col("all_rows") == 1)
        best = depths.groupBy("leaf").agg(F.min(F.when(fits, F.struct("x", "bucket"))).alias("place"), F.first("low").alias("low"), F.first("high").alias("high"))
        best = scratch.save(best, f"places-{turn}")
        keyed = rows.withColumn("leaf", leaf).join(best, "leaf")
        name = F.concat_ws(":", base, F.col("place.x").cast("string"), F.col("place.bucket").cast("string"))
        placed.append(keyed.where("place is not null").select(f"{OWN}id", "n_bytes", (F.lit(turn * BITS) + F.col("place.x")).cast("long").alias("depth"), name.alias("shard")))
        counts = best.where("place is null").agg(F.count_if(F.col("low") == F.col("high")).alias("same"), F.count_if(F.col("low") != F.col("high")).alias("open")).first()
        if counts["same"]:
            placed.append(_pages(keyed.where("place is null and low = high"), limit, turn))
        if not counts["open"]:
            return reduce(DataFrame.union, placed).select(F.col(f"{OWN}id").alias(id_col), "n_bytes", "depth", "shard")
        rows = scratch.save(keyed.where("place is null and low <> high").select(f"{OWN}id", "hash", "n_bytes"), f"open-{turn}")
        turn += 1


def _pages(copies: DataFrame, limit: int, turn: int) -> DataFrame:
    """Deals equal rows to pages: counted first, then numbered in blocks of 10,000."""
    groups = copies.groupBy(f"{OWN}id", "hash", "n_bytes").agg(F.count("*").alias("n"))
    blocks = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 10_000)))).repartition("hash", "block")
    each = blocks.withColumn("i", F.explode(F.sequence(F.col("block") * 10_000, F.least(F.col("n"), (F.col("block") + 1) * 10_000) - 1)))
    page = F.floor(F.col("i") / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))))
    return each.select(f"{OWN}id", "n_bytes", F.lit((turn + 1) * BITS).cast("long").alias("depth"), F.concat_ws(":", "hash", F.lit("page"), page.cast("string")).alias("shard"))


#: The same shards in DuckDB SQL, for tables without copies of a row.
SQL = f"""
with r as (select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes, md5(coalesce(cast(doc_id as varchar), '')) || md5(coalesce(text, '')) as h from documents),
d as (select *, unnest(range(0, 61)) as depth from r),
b as (select *, case when depth = 0 then 0 else (depth - 1) // {BITS} end as turn from d),
p as (select *, substr(h, 1, turn * {_DIGITS}) as base, depth - turn * {BITS} as x, (cast('0x' || substr(h, turn * {_DIGITS} + 1, {_DIGITS}) as integer) // (1 << ({BITS} - (depth - turn * {BITS})))) as bucket from b),
s as (select *, sum(n_bytes) over w as all_bytes, count(*) over w as all_rows from p window w as (partition by depth, base, bucket)),
f as (select doc_id, h, n_bytes, min(depth) as depth from s where all_bytes <= {LIMIT} or all_rows = 1 group by all)
select p.doc_id, p.n_bytes, cast(p.depth as bigint) as depth, p.base || ':' || p.x || ':' || p.bucket as shard from f join p using (doc_id, h, depth)
"""
