"""Secret scans (DataFrame functions only).

Base kinds are regular expressions. The method adds spans of kind ``entropy``:
candidate strings of one character class (hexadecimal, letters and digits, or
URL-safe base64) are passed by a window of ``WINDOW`` characters whose counts
are updated by the entering and the leaving character, and with them the
Shannon entropy. A candidate with a window at its class's threshold is
reported from the first such window's start to the last one's end, unless an
allow-list pattern or literal matches it or a base span overlaps it.

Spans are code point offsets, end exclusive. Defined results: null texts are
empty and have no spans; other columns are dropped, whatever their names;
repeated rows are scanned row by row; texts and runs of any length are scanned
whole; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Maximal runs only; a digit and a letter are needed, which ordinary words lack.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
#: Lowest window entropy in bits, by character class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.4, "base64": 3.6}
ALLOW_PATTERNS = (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(?i)example|sample|placeholder|dummy|changeme", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", r"^/?[a-z]++[0-9]?+(?:/[a-z]++[0-9]?+)++$")
ALLOW_LITERALS = ("da39a3ee5e6b4b0d3255bfef95601890afd80709", "d41d8cd98f00b204e9800998ecf8427e")
KINDS = ("assign", "access", "hex", "entropy")
_BLOCK = 128
#: Starts of windows in a part of a candidate, by level.
LONG, SHORT = 8192, 128


def _with(value: Column, body) -> Column:
    """Evaluates ``value`` once and gives it to ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def _starts(sizes: Column) -> Column:
    """Exclusive running sums of an array, block by block."""

    def sums(a: Column) -> Column:
        zero = F.array(F.lit(0).cast("bigint"))
        return F.aggregate(a, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def blocks(all_sizes: Column) -> Column:
        n = F.floor((F.size(all_sizes) + _BLOCK - 1) / _BLOCK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda b: sums(F.slice(all_sizes, b * _BLOCK + 1, _BLOCK)))
        def joined(parts: Column) -> Column:
            return _with(sums(F.transform(parts, lambda p: F.element_at(p, -1))), lambda base: F.flatten(F.transform(parts, lambda p, i: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + F.get(base, i)))))
        return _with(cut, joined)

    return _with(sizes, blocks)


def _spans(text: str, pattern: str, kind: str, keep) -> Column:
    """Array of (start, kind, end, hit) of the matches that ``keep`` accepts."""
    gaps, hits = F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))

    def place(x: Column) -> Column:
        sizes = F.transform(x["hits"], lambda h, i: (F.length(h) + F.length(F.get(x["gaps"], i + 1))).cast("bigint"))
        first = F.length(F.get(x["gaps"], 0)).cast("bigint")
        return _with(_starts(sizes), lambda at: F.transform(x["hits"], lambda h, i: F.struct((F.get(at, i) + first).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (F.get(at, i) + first + F.length(h)).alias("end"), h.alias("hit"))))

    found = F.filter(_with(F.struct(gaps.alias("gaps"), hits.alias("hits")), place), lambda s: keep(s["hit"]))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hit:string>>")
    return F.when(F.col(text).rlike(pattern), found).otherwise(none)


def _cut(text: Column, size: int, overlap: int) -> Column:
    """Array of (at, part): stretches of ``size`` starts with the ``overlap`` characters after them."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - overlap - 1) / size).cast("int"), F.lit(0)))
    return F.transform(starts, lambda i: F.struct((i * size).alias("at"), F.substring(text, i * size + 1, F.lit(size + overlap)).alias("part")))


def _hot_window(hit: Column, window: int) -> Column:
    """Struct (first, last) of the windows at the class's threshold, or nulls.

    The state holds the counts of the 80 characters from ``+`` to ``z``, one
    character each in a string, and the sum of c * log2(c); each step changes
    the counts of the entering and the leaving character. Entropy is
    log2(w) - sum / w. Long candidates are cut into overlapping parts, in two
    levels, so the work is linear in their length.
    """
    limit = F.when(hit.rlike("^[0-9a-fA-F]+$"), THRESHOLDS["hex"]).when(hit.rlike("^[A-Za-z0-9]+$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
    weight = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)
    zero = 32  # the character for a count of 0
    start = F.struct(F.lit(chr(zero) * 80).alias("counts"), F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def scanned(part: Column, limit: Column) -> Column:
        place = lambda i: F.ascii(F.substring(part, i, F.lit(1))) - 42
        count = lambda counts, at: F.ascii(F.substring(counts, at, F.lit(1))) - zero
        changed = lambda counts, at, c: F.overlay(counts, F.char(c + zero), at)

        def moved(a: Column, i: Column, x: Column) -> Column:
            full = i > window
            up, down = count(a["counts"], x["come"]), F.when(full, count(a["counts"], x["go"])).otherwise(0)
            left = F.when(full, changed(a["counts"], x["go"], down - 1)).otherwise(a["counts"])
            counts = changed(left, x["come"], up + 1)
            s = a["s"] + weight(up + 1) - weight(up) + F.when(full, weight(down - 1) - weight(down)).otherwise(0.0)
            return F.when(full & (x["come"] == x["go"]), F.struct(a["counts"].alias("counts"), a["s"].alias("s"))).otherwise(F.struct(counts.alias("counts"), s.alias("s")))

        def step(a: Column, i: Column) -> Column:
            x = F.struct(place(i).alias("come"), F.when(i > window, place(i - window)).alias("go"))
            hot = lambda m: (i >= window) & (F.round(math.log2(window) - m["s"] / window, 9) >= limit)
            return _with(x, lambda x: _with(moved(a, i, x), lambda m: F.struct(m["counts"].alias("counts"), m["s"].alias("s"), F.when(a["first"].isNull() & hot(m), i - window).otherwise(a["first"]).alias("first"), F.when(hot(m), i).otherwise(a["last"]).alias("last"))))

        return F.aggregate(F.sequence(F.lit(1), F.length(part)), start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    def joined(parts: Column) -> Column:
        return F.struct(F.array_min(F.transform(parts, lambda p: p["first"])).alias("first"), F.array_max(F.transform(parts, lambda p: p["last"])).alias("last"))

    def spread(text: Column, size: int, scan) -> Column:
        placed = lambda p: _with(scan(p["part"]), lambda r: F.struct((p["at"] + r["first"]).alias("first"), (p["at"] + r["last"]).alias("last")))
        return _with(F.transform(_cut(text, size, window - 1), placed), joined)

    return _with(limit, lambda limit: spread(hit, LONG, lambda long: spread(long, SHORT, lambda short: scanned(short, limit))))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, allow_patterns=ALLOW_PATTERNS, allow_literals=ALLOW_LITERALS) -> DataFrame:
    """Id, text and ``found``: all spans as structs (start, kind, end, hit) by start, then kind."""
    if not 1 < window < 90:
        raise ValueError("window must be between 2 and 89 characters")
    text = f"{OWN}text"
    df = docs.select(F.col(id_col).alias(f"{OWN}id"), F.coalesce(F.col(text_col), F.lit("")).alias(text))
    value = lambda h: F.regexp_extract(h, ASSIGN, 2)
    df = df.withColumns({
        f"{OWN}base": F.concat(_spans(text, ASSIGN, "assign", lambda h: F.length(value(h)) >= 6), _spans(text, ACCESS, "access", lambda h: F.length(h) >= 20), _spans(text, HEX, "hex", lambda h: F.length(h) >= 24)),
        f"{OWN}cand": _spans(text, CANDIDATE, "entropy", lambda h: F.lit(True)),
    })
    base = F.col(f"{OWN}base")
    fine = lambda h: ~(h.isin(*allow_literals) if allow_literals else F.lit(False)) & ~F.greatest(F.lit(False), F.lit(False), *(h.rlike(p) for p in allow_patterns))
    free = F.filter(f"{OWN}cand", lambda c: fine(c["hit"]) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
    hot = F.transform(free, lambda c: _with(_hot_window(c["hit"], window), lambda w: F.struct((c["start"] + w["first"]).alias("start"), c["kind"].alias("kind"), (c["start"] + w["last"]).alias("end"), F.substring(c["hit"], w["first"] + 1, w["last"] - w["first"]).alias("hit"))))
    df = df.withColumn("found", F.array_sort(F.concat(base, F.filter(hot, lambda x: x["start"].isNotNull()))))
    return df.select(F.col(f"{OWN}id").alias(id_col), F.col(text).alias("text"), "found")


def span_columns(found: DataFrame, id_col: str = "doc_id", kinds=KINDS, n_base: int = 3) -> DataFrame:
    """Counts of base kinds, digest of base spans and all spans as text."""
    names = F.array(*map(F.lit, kinds))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{kinds[k]}") for k in range(n_base)]
    return found.select(id_col, *counts, F.sha2(line(F.filter("found", lambda s: s["kind"] < n_base)).cast("binary"), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


def _of_kind(k: int) -> Column:
    return F.filter("found", lambda s: s["kind"] == k)
