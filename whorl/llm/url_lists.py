"""URL filters by a temporal list join (DataFrame functions only).

Lists are histories: a key (host, domain or URL prefix) is added to or removed
from a list at a time. A key's changes become validity intervals. A capture is
tested against the entries of its host, of the host's parent domains and of the
prefixes of its path that were active at its fetch time: the as-of join takes
the last change at or before that time.

Intervals are cut into months and the join is on (kind, key, month), so a
capture meets only the entries of its own month, whatever the length of a
key's history. Keys asked by more than one in ``RARE`` captures are hot: there
can be at most ``RARE`` times as many of them as a capture has keys, so they are
broadcast, their captures are dealt to ``SALTS`` tasks and only their entries
are copied.

Of the active entries the longest key decides; between equal keys an allow
entry wins, then the list's name. Hosts are compared without case, paths with
it. Defined results: a null or unparsable URL, or
a null time, has verdict ``none``; changes with a null field are ignored;
changes of a key at the same time are ordered with removals first; repeated
captures are tested row by row; URLs, paths and lists of any length are used
whole; other columns are dropped, whatever their names; an empty list leaves
every capture at ``none`` and an empty table of captures gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN

SALTS, RARE = 16, 1000


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def candidate_keys(url: Column) -> Column:
    """Array of (kind, key): the host, its parent domains and all its path prefixes."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    parts = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("key")))
    none = F.array().cast("array<struct<kind:string,key:string>>")
    every = F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("key"))), domains, F.when(F.size(parts) > 0, prefixes).otherwise(none))
    return F.when(host != "", every).otherwise(none)


def _host_lowered(kind: Column, key: Column) -> Column:
    """A key with its host in lower case; the path of a prefix keeps its case."""
    host = F.substring_index(key, "/", 1)
    return F.when(kind == "prefix", F.concat(F.lower(host), F.substring(key, F.length(host) + 1, F.length(key)))).otherwise(F.lower(key))


def validity(changes: DataFrame) -> DataFrame:
    """Intervals [valid_from, valid_to) of each list key from its dated changes.

    ``changes``: list, action (block/allow), kind, key, at (timestamp), listed (boolean).
    """
    whole = changes.dropna(subset=["list", "action", "kind", "key", "at", "listed"]).select("list", "action", "kind", _host_lowered(F.col("kind"), F.col("key")).alias("key"), "at", "listed")
    history = Window.partitionBy("list", "action", "kind", "key").orderBy("at", "listed")
    return whole.withColumn("valid_to", F.lead("at").over(history)).where("listed and (valid_to is null or valid_to > at)").withColumnRenamed("at", "valid_from").drop("listed")


def url_filter(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """One row per capture: id, url, time, ``verdict`` and the deciding entry."""
    own = captures.select(F.monotonically_increasing_id().alias(f"{OWN}row"), F.col(id_col).alias(f"{OWN}id"), F.col(url_col).alias(f"{OWN}url"), F.col(time_col).alias(f"{OWN}at"))
    months = lambda t: F.year(t) * 12 + F.month(t)
    asked = own.select("*", F.explode_outer(candidate_keys(F.col(f"{OWN}url"))).alias("c")).select(f"{OWN}row", f"{OWN}id", f"{OWN}url", f"{OWN}at", "c.kind", "c.key", months(F.col(f"{OWN}at")).alias("month"))
    last = captures.agg(F.max(months(F.col(time_col))).alias("last"), F.count("*").alias("all"))
    listed = validity(changes)
    hot = asked.where("key is not null").groupBy("kind", "key").agg(F.count("*").alias("n")).crossJoin(F.broadcast(last)).where(F.col("n") * RARE > F.col("all")).select("kind", "key", F.lit(SALTS).alias("salts"))
    until = F.least(F.coalesce(months(F.col("valid_to")), F.col("last")), F.col("last"))
    cut = listed.crossJoin(F.broadcast(last)).where(months(F.col("valid_from")) <= until)
    cut = cut.select("kind", "key", "valid_from", "valid_to", "action", "list", F.explode(F.sequence(months(F.col("valid_from")), until)).alias("month"))
    entries = cut.join(F.broadcast(hot), ["kind", "key"], "left").select(*cut.columns, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    entries = entries.groupBy("kind", "key", "month", "salt").agg(F.collect_list(F.struct("valid_from", "valid_to", "action", "list")).alias("intervals"))
    asked = asked.join(F.broadcast(hot), ["kind", "key"], "left").withColumn("salt", F.pmod(F.xxhash64(f"{OWN}row"), F.coalesce("salts", F.lit(1))).cast("int"))
    active = F.filter("intervals", lambda i: (i["valid_from"] <= F.col(f"{OWN}at")) & (i["valid_to"].isNull() | (i["valid_to"] > F.col(f"{OWN}at"))))
    rank = lambda i: F.struct(F.length("key").alias("size"), (i["action"] == "allow").alias("allow"), F.when(F.col("kind") == "prefix", 2).when(F.col("kind") == "host", 1).otherwise(0).alias("narrow"), i["list"].alias("list"), F.col("kind").alias("kind"), F.col("key").alias("key"), i["action"].alias("action"), i["valid_from"].alias("valid_from"))
    hits = asked.join(entries, ["kind", "key", "month", "salt"], "left").withColumn("best", F.array_max(F.transform(active, rank)))
    out = hits.groupBy(f"{OWN}row").agg(F.first(f"{OWN}id").alias(id_col), F.first(f"{OWN}url").alias(url_col), F.first(f"{OWN}at").alias(time_col), F.max("best").alias("best"))
    return out.select(id_col, url_col, time_col, F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.list").alias("list"), F.col("best.kind").alias("kind"), F.col("best.key").alias("key"), F.col("best.valid_from").alias("valid_from"))
