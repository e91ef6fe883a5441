"""Periodic run detection: all-lag vectorised scan over word ids.

A run is a stretch of consecutive words with smallest period q and a length of
at least ``max(min_length, min_exp * q)`` that no neighbouring word extends
with that period. The scan compares the array of word ids with each of its
shifts q up to n / min_exp; true stretches of such a comparison that are long
enough are runs, unless their words have a shorter period.

A stretch that counts spans at least ``min_exp - 1`` multiples of q in a row, so
each shift is first compared at the multiples of q only, for many shifts in one
array operation, and in full around the places where so many neighbours are
equal. That loses nothing and takes about n * ln(n) comparisons a text.
A text that repeats one word has a true stretch at every shift: those inside
a run whose period divides the shift are passed over.

Texts up to ``long_chars`` code points are scanned where they lie, without a
shuffle. Longer ones are cut into ranges of shifts of about equal work that
Spark deals to tasks; their runs meet again by row.

Defined results: null, empty and blank texts have no words and no runs, and
collapse to an empty text; a null id stays null; repeated rows are scanned row
by row; ties in the order of runs are broken by start, then period; other
columns are dropped, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, Scratch, words_of

#: Code points above which the shifts of a text are dealt to several tasks.
LONG_CHARS = 1 << 20
#: Compared places that one array operation holds.
PLACES = 1 << 19
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_ids(words: list[str]) -> np.ndarray:
    seen: dict[str, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int32)


def _sampled(x: np.ndarray, lo: int, hi: int, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shift, place) where x equals itself shifted at ``need`` multiples of the shift in a row, by shift and place."""
    n = len(x)
    while lo < hi:
        q = np.arange(lo, min(hi, lo + max(1, PLACES * lo // n)))
        lo = int(q[-1]) + 1
        count = (n - 1) // q + 1  # multiples of q below n
        shift = np.repeat(q, count)
        place = (np.arange(len(shift)) - np.repeat(np.cumsum(count) - count, count)) * shift
        value = x[place]
        equal = (value[1:] == value[:-1]) & (place[1:] > 0)
        for _ in range(need - 1):
            equal = equal[1:] & equal[: len(equal) - 1]
        at = np.flatnonzero(equal)
        if len(at):
            yield shift[at], place[at]


def _stretch(x: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The longest [b, f) around i with x[j] == x[j + q] for every j in it."""
    f, size, end = i, 64, len(x) - q
    while f < end:
        bad = np.flatnonzero(x[f : min(f + size, end)] != x[f + q : min(f + size, end) + q])
        if len(bad):
            f += int(bad[0])
            break
        f, size = min(f + size, end), size * 2
    b, size = i, 64
    while b > 0:
        a = max(0, b - size)
        bad = np.flatnonzero(x[a:b] != x[a + q : b + q])
        if len(bad):
            b = a + int(bad[-1]) + 1
            break
        b, size = a, size * 2
    return b, f


def _smallest_period(block: np.ndarray) -> int:
    """The smallest period of a block that divides its length."""
    p, rest, r = len(block), len(block), 2
    while rest > 1:
        r = rest if r * r > rest else r
        if rest % r:
            r += 1
            continue
        rest //= r
        if np.array_equal(block[: -(p // r)], block[p // r :]):
            p //= r
    return p


def find_runs(x: np.ndarray, lo: int = 1, hi: int | None = None, min_exp: int = 4, min_length: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with lo <= period < hi, by start and period."""
    n = len(x)
    hi = min(n // min_exp + 1, hi or n + 1)
    known: dict[int, tuple[list[int], list[int]]] = {}  # period: starts and ends; same periods overlap by less than one
    found = []
    for shifts, places in _sampled(x, lo, hi, min_exp - 1):
        keys, at = shifts * (n + 1) + places, 0
        while at < len(keys):
            q, i, past = int(shifts[at]), int(places[at]), 0
            for p, (starts, ends) in known.items():
                if q % p == 0 and (k := bisect.bisect_right(starts, i) - 1) >= 0 and i + q < ends[k]:
                    past = ends[k] - q
                    break
            else:
                b, past = _stretch(x, i, q)
                if past - b + q >= max(min_length, min_exp * q):
                    p = _smallest_period(x[b : b + q])
                    starts, ends = known.setdefault(p, ([], []))
                    k = bisect.bisect(starts, b)
                    starts.insert(k, b)
                    ends.insert(k, past + q)
                    if p == q:
                        found.append((b, past + q - b, q))
            at = max(at + 1, int(np.searchsorted(keys, q * (n + 1) + past)))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return " ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return " ".join(words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0))


def _arrow_runs(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], _RUN_TYPE)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exp: int = 4, min_length: int = 6, long_chars: int = LONG_CHARS) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``runs`` (by start, then period) and the ``collapsed`` text."""
    if min_exp < 2:
        raise ValueError("a run repeats its period at least twice")
    out = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUN_TYPE), ("collapsed", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for text in part.column(1):
                    words = _WORD.findall(text.as_py() or "")
                    runs = find_runs(word_ids(words), min_exp=min_exp, min_length=min_length)
                    rows.append((len(words), runs, collapsed(words, runs)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), _arrow_runs([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.string())], schema=out)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    schema = f"id bigint, n_words bigint, runs {_RUNS}, collapsed string"
    found = source.where(~is_long).mapInArrow(scan, schema)
    scratch = Scratch(docs.sparkSession, "periodic")
    large = scratch.save(_with_ids(source.where(is_long)), "long")
    if not large.isEmpty():
        found = found.union(_by_ranges(large, min_exp, min_length, long_chars))
    return found.withColumnRenamed("id", id_col)


def _with_ids(rows: DataFrame) -> DataFrame:
    """Adds the word ids (4 bytes each) and a number of the row."""
    out = pa.schema([("id", pa.int64()), ("text", pa.string()), ("row", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                ids = word_ids(_WORD.findall(row.column(1)[0].as_py())).tobytes()
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1).cast(pa.string()), row.column(2), pa.array([ids], pa.binary())], schema=out)

    return rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "id bigint, text string, row bigint, ids binary")


def _by_ranges(large: DataFrame, min_exp: int, min_length: int, long_chars: int) -> DataFrame:
    """Runs of long texts: ranges of shifts of about equal work, dealt to tasks."""
    lags = F.floor(F.octet_length("ids") / 4 / min_exp)
    parts = F.greatest(F.lit(1), F.ceil(F.length("text") / long_chars)).cast("int")
    edge = lambda j: F.when(j >= F.col("parts"), F.col("lags") + 1).otherwise(F.floor(F.pow(F.col("lags") + 1.0, j / F.col("parts")))).cast("long")
    cut = large.select("row", "ids", lags.alias("lags"), parts.alias("parts")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select("row", "j", "ids", edge(F.col("j")).alias("lo"), edge(F.col("j") + 1).alias("hi")).where("lo < hi")
    ranged = pa.schema([("row", pa.int64()), ("runs", _RUN_TYPE)])
    final = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUN_TYPE), ("collapsed", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [find_runs(np.frombuffer(ids, np.int32), lo, hi, min_exp, min_length) for ids, lo, hi in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _arrow_runs(runs)], schema=ranged)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                words = _WORD.findall(row.column(1)[0].as_py())
                runs = [(r["start"], r["length"], r["period"]) for r in row.column(2)[0].as_py() or []]
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([len(words)], pa.int64()), _arrow_runs([runs]), pa.array([collapsed(words, runs)], pa.string())], schema=final)

    found = cut.repartition("row", "j").select("row", "ids", "lo", "hi").mapInArrow(scan, f"row bigint, runs {_RUNS}")
    order = lambda a, b: F.when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1)).when(a.period != b.period, F.when(a.period < b.period, -1).otherwise(1)).otherwise(0)
    runs = found.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("runs")), order).alias("runs"))
    return large.join(runs, "row", "left").select("id", "text", "runs").mapInArrow(finish, f"id bigint, n_words bigint, runs {_RUNS}, collapsed string")


def planted(doc_id: Column, text: Column, one_in: int = 10) -> Column:
    """The text with the run of the query's contract; one text in ``one_in`` by the CRC-32 of the id gets one.

    The words from the a-th on repeat the p words that stand there. A text
    without words, or with a null id, stays as it is.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, words = F.floor(h / one_in), words_of(text)
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return F.when((h % one_in == 0) & (n > 0), made).otherwise(text)


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the run of the greatest exact exponent, and digests of all runs and of the collapsed text."""
    mass = lambda a, b: a.length * b.period
    first = lambda a, b: F.when(mass(a, b) != mass(b, a), F.when(mass(a, b) > mass(b, a), -1).otherwise(1)).when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1)).when(a.period != b.period, F.when(a.period < b.period, -1).otherwise(1)).otherwise(0)
    best, listed = f"{OWN}best", F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    hexed = lambda text: F.sha2(text.cast("binary"), 256)
    rows = found.withColumn(best, F.get(F.array_sort("runs", first), 0))
    of = lambda name: F.col(best).getField(name)
    return rows.select(id_col, F.size("runs").cast("long").alias("n_runs"), *(of(c).alias(c) for c in ("start", "length", "period")), F.floor(1000 * of("length") / of("period")).alias("exponent_milli"), hexed(listed).alias("runs_sha256"), hexed(F.col("collapsed")).alias("collapsed_sha256"))
