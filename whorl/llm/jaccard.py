"""N-gram Jaccard join by count vectors, R-trees and exact verification.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets
of word shingles. The join runs in these steps, all of them lossless:

1. Sketch. Documents with equal sets form one class (64-bit set sums). Each
   class gets its count vector (shingles hashed into ``GROUPS`` groups) and its
   directory keys. A link of sets A and B leaves at most
   ``(100 - percent) * (|A| + |B|) / (100 + percent)`` shingles unshared, so if
   shingles are dealt into more groups than that, some group has the same
   content in both. The directory therefore is keyed by the content of single
   groups, at a level that bounds the size of both partners.
2. Cells. There are a quarter more groups than needed, so linked sets meet in
   many cells: a class that meets others in fewer cells than that has no link
   and goes, and one that is in fewer hot cells (over ``HOT`` members) than that
   meets its partners elsewhere and leaves the hot ones. Cells with the same
   members are searched once.
3. Hubs. Every class of a cell outside the component of the cell's first class
   is paired with that class only; pairs pass the count-vector bound (overlap is
   at most the sum of coordinate minima) and are then verified on the texts.
   Components are merged, the first class leaves the cell, cells of a single
   component go, and the next round starts, as long as rounds find links.
4. Rest. Cells of more than ``CELL`` members are split by the rarest shingles of
   their classes (see ``_refined``). In all that are left, classes outside the first one's component
   probe R-trees over the count vectors of bounded parts of the cell; a node is
   entered only if the sum of minima of the probe and the node's upper corner
   reaches the needed overlap. Surviving pairs between different components are
   verified too, those of the highest bound first: a probe offers its
   ``NEAREST`` partners, and while any probe has more, components are merged
   and the cells of such probes are searched again for four times as many,
   until all have been offered. Groups of many links thus merge early.

Pairs inside one component are never enumerated, so copies cost linear work.
The top of one global R-tree is replaced by the directory because boxes of
such vectors overlap in nearly all coordinates and a query would enter nearly
every leaf.

Defined results: null, empty and blank texts have no shingles and link with
nothing; rows with a null id link like others, their class takes the smallest
id that it reaches, or null if there is none; rows that share an id are
compared by their texts, each with its own component; repeated rows are kept;
other columns are dropped; texts of any length are sets as a whole; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, Scratch
from .shingles import mix, shingle_set

GROUPS = 256
#: Most classes of one cell that a task indexes at a time.
CELL = 512
#: Members above which a cell is hot, and pairs that one copy of a hub's text serves.
HOT, CHUNK = 64, 1000
#: Bits of the filter on digests (8 MB at most, whatever the input).
BITS = 1 << 26
#: Bits of a directory key.
KEY_BITS = 48
#: Rows of cells that one tree task is given.
TASK = 50_000
#: Share of links among the tried pairs below which hub rounds end.
PAYS = 0.02
#: Nearest partners that a probe offers in the first tree round; four times as many in each later one.
NEAREST = 4
_U = np.uint64


@lru_cache(maxsize=8)
def levels(percent: int, up_to: int = 1 << 40) -> np.ndarray:
    """Lower set size of each level; partners are at most one level apart."""
    edges = [1]
    while edges[-1] < up_to:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    return np.array(edges)


def unshared(percent: int, total: int) -> int:
    """Most shingles outside the overlap of linked sets of ``total`` shingles together."""
    return (100 - percent) * total // (100 + percent)


def directory_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """Keys of the cells that a set belongs to, and how many cells it shares with a partner.

    The cells of a level serve pairs of sets from the level below it and of one
    from each; pairs from the level itself meet at the next one. Keys have
    ``KEY_BITS`` bits: two that are equal by chance cost a bound test and lose
    nothing. The low bit of a key is that of its level; the two counts are by that bit.
    With m groups and at most d of them differing, linked sets agree in m - d
    groups, of which no more are empty than the set has empty groups.
    """
    edges = levels(percent)
    own = int(np.searchsorted(edges, len(s), side="right")) - 1
    keys, least, spread, value = [], [1, 1], mix(s, 7), mix(s, 11)
    for level in (own, own + 1):
        differing = unshared(percent, int(edges[level]) + int(edges[level + 1]) - 2)
        if not differing:  # only equal sets link at this size
            continue
        spare = 1 + differing // 4
        m = differing + 1 + spare
        group = (spread % _U(m)).astype(np.int64)
        sizes, content = np.bincount(group, minlength=m), np.zeros(m, _U)
        np.add.at(content, group, value)
        key = mix(content + np.arange(m).astype(_U) * _U(0x632BE59BD9B4E019), 100 + level)
        key = (key >> _U(64 - KEY_BITS)) & ~_U(1) | _U(level & 1)
        empty = int((sizes == 0).sum())
        least[level & 1] = max(1, m - differing - empty)
        # Up to ``spare`` groups empty in both sets cannot use up the groups that must agree.
        keys.append(key if empty > spare else key[sizes > 0])
    return np.concatenate(keys) if keys else np.empty(0, _U), least


def packed(counts: np.ndarray) -> bytes:
    """Count vector as bytes: one a group where all counts allow it, else four."""
    return counts.astype(np.uint8 if counts.max() < 256 else "<i4").tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    """Matrix of packed vectors, in the narrowest type that holds them all."""
    vecs = [np.frombuffer(raw, np.uint8 if len(raw) == GROUPS else "<i4") for raw in rows]
    return np.stack(vecs) if vecs else np.empty((0, GROUPS), np.uint8)


def sketch(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """id, digest, n, cls, vec, keys, least of every row; the last three once per class and task."""
    out = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("cls", pa.int64()), ("vec", pa.binary()), ("keys", pa.list_(pa.int64())), ("least", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for text in part.column(2):
                    s = shingle_set(text.as_py() or b"", words)
                    if not len(s):
                        rows.append((0, None, None, None, None))
                        continue
                    cls = class_of(s)
                    vec = keys = least = None
                    if cls not in seen:
                        if len(seen) > 1_000_000:  # bounded; a repeat only repeats keys
                            seen.clear()
                        seen.add(cls)
                        keys, least = directory_keys(s, percent)
                        keys = keys.view(np.int64)
                        vec = packed(np.bincount((mix(s, 3) >> _U(40)).astype(np.int64) % GROUPS, minlength=GROUPS))
                    rows.append((len(s), cls, vec, keys, least))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.binary()), *(pa.array([r[i] for r in rows], t.type) for i, t in enumerate(list(out)[2:]))], schema=out)

    source = docs.select(F.col("id").cast("long"), _digest("text"), F.col("text").cast("binary"))
    return source.mapInArrow(run, "id bigint, digest binary, n bigint, cls bigint, vec binary, keys array<bigint>, least array<int>")


def class_of(s: np.ndarray) -> int:
    return int(mix(s, 1).sum(dtype=_U).astype(np.int64))


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("digest")


class CountTree:
    """R-tree over count vectors: packed leaves, bounding corners above them."""

    FAN = 16

    def __init__(self, points: np.ndarray):
        # Sort-tile packing: by total first, then by the coordinate of widest spread.
        total, spread = points.sum(1), points.max(0) - points.min(0)
        self.order = np.lexsort((points[:, int(np.argmax(spread))], total // max(1, int(total.max()) // 8 or 1)))
        self.levels = [points[self.order]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), self.FAN), axis=0))

    def reach(self, probe: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Indexes of points whose summed minima with the probe reach ``need`` (one value per point)."""
        return self.pairs(probe[None], need[None])[1]

    def pairs(self, probes: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, point) indexes of all pairs whose summed minima reach ``need`` (probes x points)."""
        needs = [need[:, self.order]]
        for below in self.levels[:-1]:
            needs.append(np.minimum.reduceat(needs[-1], np.arange(0, len(below), self.FAN), axis=1))
        who, nodes = np.arange(len(probes)), np.zeros(len(probes), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            sums = [np.minimum(level[nodes[i : i + 4096]], probes[who[i : i + 4096]]).sum(1, dtype=np.int64) for i in range(0, len(nodes), 4096)]
            entered = np.concatenate([np.empty(0, np.int64), *sums]) >= needs[depth][who, nodes]
            who, nodes = who[entered], nodes[entered]
            if depth:
                who, nodes = np.repeat(who, self.FAN), (nodes[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                inside = nodes < len(self.levels[depth - 1])
                who, nodes = who[inside], nodes[inside]
        return who, self.order[nodes]


def _verify(pairs: DataFrame, points: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of classes that link, checked on the sets of their texts.

    A hub's text is sent once for ``CHUNK`` of its pairs and held while they
    stream by, so a hub with many partners is spread over tasks.
    """
    side = lambda x: points.select(*(F.col(c).alias(f"{x}{c}") for c in ("cls", "digest", "n", "vec"))).withColumnRenamed(f"{x}cls", x)
    near = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_bounded(percent), "a bigint, b bigint, adigest binary, bdigest binary")
    near = scratch.save(near, f"{name}-near")
    chunks = near.groupBy("a").agg(F.floor((F.count("*") - 1) / CHUNK).cast("int").alias("top"))
    dealt = near.join(chunks, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("top") + 1).cast("int"))
    asked = dealt.select("a", "chunk", F.col("b").alias("cls"), F.col("bdigest").alias("digest"), F.lit(1).alias("turn"))
    hubs = dealt.select("a", "chunk", F.col("a").alias("cls"), F.col("adigest").alias("digest"), F.lit(0).alias("turn")).distinct()
    both = asked.union(hubs)
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, None
        for batch in batches:
            links = []
            for a, cls, turn, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                s = shingle_set(text, words)
                if not turn:
                    hub, held = a, s
                    continue
                if hub != a:
                    raise ValueError("a pair came without its hub")
                shared = len(np.intersect1d(held, s, assume_unique=True))
                if 100 * shared >= percent * (len(held) + len(s) - shared):
                    links.append((a, cls))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], schema=out)

    rows = both.join(texts, "digest").select("a", "chunk", "turn", "cls", "text").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "turn")
    links = scratch.save(rows.select("a", "cls", "turn", "text").mapInArrow(run, "a bigint, b bigint").distinct(), f"{name}-links")
    scratch.drop(f"{name}-near")
    return links


def _bounded(percent: int):
    """Keeps the pairs whose summed coordinate minima reach the needed overlap."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("adigest", pa.binary()), ("bdigest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (unpacked(batch.column(f"{x}vec").to_pylist()) for x in "ab")
            sizes = batch.column("an").to_numpy() + batch.column("bn").to_numpy()
            fits = (100 + percent) * np.minimum(a, b).sum(1, dtype=np.int64) >= percent * sizes
            yield batch.select(out.names).filter(pa.array(fits, pa.bool_())).cast(out)

    return run


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(cls, label) of every linked class: the smallest class that it reaches.

    Each round takes the smallest label of the neighbours and then the label's
    own label, so the number of rounds follows the logarithm of the paths.
    """
    edges = scratch.save(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.save(edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        seen = edges.join(labels.select(F.col("cls").alias("b"), "label"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("near"))
        taken = labels.join(seen, "cls").select("cls", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("cls").alias("mid"), F.col("label").alias("far"))
        now = scratch.save(taken.join(jump, "mid", "left").select("cls", F.least("mid", F.coalesce("far", "mid")).alias("label"), "old"), f"{name}-{turn}")
        changed = now.where("label <> old").limit(1).count()
        scratch.drop(f"{name}-{turn - 1}")
        labels = now.drop("old")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels


def _cells(sketched: DataFrame, scratch: Scratch) -> DataFrame:
    """key, cls: the cells in which linked classes meet, one of those with equal members."""
    same = Window.partitionBy("key").orderBy("cls")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sketched.select("cls", F.explode("keys").alias("key"))
    seen = rows.select("key", "cls", F.first("cls").over(whole).alias("first"), F.last("cls").over(whole).alias("last"), F.count("*").over(whole).alias("members"), F.lag("cls").over(same).alias("before"))
    met = seen.where("first <> last and (before is null or before <> cls)").select("key", "cls", (F.col("members") > HOT).alias("hot"))
    shared = scratch.save(met.withColumn("level", F.col("key").bitwiseAND(F.lit(1)).cast("int")), "shared")
    least = sketched.where("least is not null").select("cls", F.posexplode("least").alias("level", "need")).distinct()
    counts = shared.groupBy("cls", "level").agg(F.count("*").alias("n"), F.count_if("hot").alias("n_hot"))
    rich = counts.join(least, ["cls", "level"]).where("n >= need").select("cls", "level", (F.col("n_hot") < F.col("need")).alias("cool"))
    kept = scratch.save(shared.join(rich, ["cls", "level"]).where("not (hot and cool)").select("key", "cls"), "kept")
    scratch.drop("shared")
    cells = scratch.save(_one_of_each(kept), "cells")
    scratch.drop("kept")
    return cells


def _one_of_each(cells: DataFrame) -> DataFrame:
    """The cells of two members or more, one of those with equal members."""
    members = [F.bit_xor(F.xxhash64("cls", F.lit(salt))).alias(f"members{salt}") for salt in (1, 2)]
    sets = cells.groupBy("key").agg(F.count("*").alias("n"), *members).where("n > 1").groupBy("n", "members1", "members2").agg(F.min("key").alias("key"))
    return cells.join(sets, "key", "left_semi")


def rarest(n: Column, percent: int) -> Column:
    """How many of a set's n shingles, rarest first, hold one that any linked partner has among its own."""
    return n - F.ceil(n * percent / 100).cast("long") + 1


def _refined(cells: DataFrame, labels: DataFrame | None, points: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """``cells`` with those of over ``CELL`` members split by rare shingles.

    All sets are put into one order, rarest shingles first. Linked sets share
    at least ``percent`` of the larger one, so they share a shingle among the
    few rarest of each (``rarest``); classes of large cells therefore need to meet only where
    those are equal. Texts that have a common part and differ beyond the limit
    have rare shingles of their own and meet nowhere, however many they are.
    """
    named = scratch.save(_named(cells, labels), "wide-named")
    wide = scratch.save(named.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("key"), "wide")
    if wide.isEmpty():
        return named.select("key", "cls")
    out = pa.schema([("cls", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(text.as_py() or b"", words).view(np.int64) for text in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], schema=out)

    classes = named.join(wide, "key", "left_semi").select("cls").distinct()
    asked = points.select("cls", "digest", "n").join(classes, "cls", "left_semi")
    sets = scratch.save(asked.join(texts, "digest").select("cls", "text").mapInArrow(run, "cls bigint, shingles array<bigint>"), "wide-sets")
    each = sets.select("cls", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    counts = each.groupBy("shingle").agg(F.count("*").alias("times"))
    # One that is nowhere else keeps its place among the rarest, but is no place to meet.
    line = Window.partitionBy("cls").orderBy("times", "shingle")
    first = each.join(counts, "shingle").withColumn("turn", F.row_number().over(line)).where((F.col("turn") <= rarest(F.col("n"), percent)) & (F.col("times") > 1))
    split = scratch.save(first.select(F.col("shingle").alias("key"), "cls"), "wide-split")
    kept = named.join(wide, "key", "left_anti").select("key", "cls")
    # Keys of the two kinds are kept apart by their lowest bit.
    both = kept.select((F.col("key") * 2).alias("key"), "cls").union(_one_of_each(split).select(F.expr("shiftleft(key, 1) | 1"), "cls"))
    refined = scratch.save(both, "refined")
    scratch.drop("wide-named", "wide-sets", "wide-split")
    return refined


def _named(cells: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Cells with the component label of each class and the first class (``hub``) of each cell.

    Cells that hold one component only are left out.
    """
    named = cells.withColumn("label", F.col("cls")) if labels is None else cells.join(labels, "cls", "left").select("key", "cls", F.coalesce("label", "cls").alias("label"))
    first = named.groupBy("key").agg(F.min(F.struct("cls", "label")).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return named.join(first.select("key", "hub"), "key")


def _rest(named: DataFrame, points: DataFrame, percent: int, nearest: int, scratch: Scratch, name: str) -> DataFrame:
    """Candidate pairs (a, b) of different components within cells, by R-tree probes.

    Rows with a ``key`` instead name cells with a probe that has partners beyond its ``nearest``.
    """
    member = named.select("key", "cls", "label", F.col("hub.cls").alias("first"), (F.col("label") != F.col("hub.label")).alias("rest"))
    sizes = member.groupBy("key").agg(F.count_if("rest").alias("n_rest"), F.count("*").alias("n_all"))
    member = member.join(sizes, "key").join(points.select("cls", "n", "vec"), "cls")
    parts = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    part = lambda c: F.pmod(F.xxhash64("cls"), parts(c)).cast("int")
    index = member.withColumn("j", part("n_all")).withColumn("i", F.explode(F.sequence(F.lit(0), parts("n_rest") - 1))).withColumn("probe", F.lit(False))
    probe = member.where("rest").withColumn("i", part("n_rest")).withColumn("j", F.explode(F.sequence(F.lit(0), parts("n_all") - 1))).withColumn("probe", F.lit(True))
    columns = ["key", "i", "j", "probe", "cls", "label", "n", "vec"]
    blocks = scratch.save(index.select("first", *columns).union(probe.select("first", *columns)), f"{name}-blocks")
    tasks = max(1, blocks.count() // TASK)
    # Cells with one first class share members: a task that has several of them offers a pair once.
    spread = blocks.groupBy("first").agg(F.ceil(F.count("*") / TASK).alias("spread"))
    blocks = blocks.join(spread, "first").withColumn("task", F.pmod(F.xxhash64("first", "i", "j", F.pmod(F.xxhash64("key"), "spread")), F.lit(tasks)).cast("int"))

    def search(rows):
        import pandas as pd

        found, cut = [], []
        rows = rows.sort_values(["key", "i", "j", "probe"], ignore_index=True)
        vecs = unpacked(rows["vec"].to_list())
        ids, marks, sizes, probe = (rows[c].to_numpy() for c in ("cls", "label", "n", "probe"))
        where = rows[["key", "i", "j"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(1)])
        for start, end in zip(starts, np.r_[starts[1:], len(rows)], strict=True):
            middle = start + int(np.argmax(probe[start:end]))
            if middle == start:  # no probes, or no points
                continue
            points, probes = slice(start, middle), slice(middle, end)
            total = sizes[probes][:, None] + sizes[points]
            who, hit = CountTree(vecs[points]).pairs(vecs[probes], -(-percent * total // (100 + percent)))
            apart = marks[probes][who] != marks[points][hit]
            who, hit = who[apart], hit[apart]
            bound = np.minimum(vecs[points][hit], vecs[probes][who]).sum(1, dtype=np.int64) / total[who, hit]
            order = np.lexsort((ids[points][hit], -bound, who))
            who, hit = who[order], hit[order]
            turn = np.arange(len(who)) - np.searchsorted(who, who)
            a, b = (x[turn < nearest] for x in (ids[probes][who], ids[points][hit]))
            found.append(np.column_stack([np.minimum(a, b), np.maximum(a, b)]))
            if len(a) < len(who):
                cut.append(where[start, 0])
        found = pd.DataFrame(np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0), columns=["a", "b"], dtype="Int64")
        return pd.concat([found, pd.DataFrame({"key": pd.array(sorted(set(cut)), "Int64")})]).reindex(columns=["key", "a", "b"])

    offered = blocks.groupBy("task").applyInPandas(search, "key bigint, a bigint, b bigint")
    found = scratch.save(offered, f"{name}-offered")
    scratch.drop(f"{name}-blocks")
    return found


def _texts(docs: DataFrame, points: DataFrame, scratch: Scratch) -> DataFrame:
    """digest, text: one row per text that verification may ask for.

    A bitmap of the points' hashed digests, at most ``BITS`` bits, lets the scan
    leave out nearly all other texts before they are shuffled; what it lets
    through by chance goes in the exact join. Copies are merged within each
    task of the scan, so a large group sends one text a task.
    """
    bit = lambda digest: F.pmod(F.xxhash64(digest), F.lit(BITS)) + 1
    mark = bit("digest")
    bitmap = points.groupBy(F.bitmap_bucket_number(mark).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(mark)).alias("bits"))
    bitmap = scratch.save(bitmap, "bitmap")
    every = docs.select(_digest("text"), F.col("text").cast("binary").alias("text"))
    every = every.withColumn("bucket", F.bitmap_bucket_number(bit("digest"))).withColumn("at", F.bitmap_bit_position(bit("digest")))
    is_set = F.expr("getbit(cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as bigint), cast(at % 8 as int)) = 1")
    asked = every.join(F.broadcast(bitmap), "bucket").where(is_set).select("digest", "text")
    return asked.dropDuplicates(["digest"]).join(points.select("digest"), "digest", "left_semi")


def _linked(cells: DataFrame, points: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """(cls, label) of the classes with links: hub rounds while they pay, then trees."""
    links = labels = None
    done, turn = [], 0
    while True:
        turn += 1
        named = scratch.save(_named(cells, labels), f"named-{turn}")
        pairs = scratch.save(named.where(F.col("label") != F.col("hub.label")).select(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).distinct(), f"pairs-{turn}")
        n_tried = pairs.count()
        if not n_tried:
            return labels
        found = _verify(pairs, points, texts, words, percent, scratch, f"hub-{turn}")
        n_found = found.count()
        links = found if links is None else links.union(found)
        if n_found:
            labels = components(links, scratch, f"labels-{turn}")
        done.append(pairs)
        cells = named.where(F.col("cls") != F.col("hub.cls")).select("key", "cls")
        scratch.drop(f"named-{turn - 1}")
        if n_found < PAYS * n_tried:
            break
    cells = _refined(cells, labels, points, texts, words, percent, scratch)
    nearest = NEAREST
    while True:
        offered = _rest(_named(cells, labels), points, percent, nearest, scratch, f"rest-{nearest}")
        untried = lambda df, old: df.join(old.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        fresh = scratch.save(reduce(untried, done, offered.where("key is null").select("a", "b").distinct()), f"fresh-{nearest}")
        found = _verify(fresh, points, texts, words, percent, scratch, f"rest-{nearest}")
        links = links.union(found)
        if not found.isEmpty():
            labels = components(links, scratch, f"labels-rest-{nearest}")
        cut = offered.where("key is not null").select("key").distinct()
        if cut.isEmpty():
            return labels
        cells = scratch.save(cells.join(cut, "key", "left_semi"), f"cells-{nearest}")
        done.append(fresh)
        nearest *= 4


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``component`` and ``digest``.

    ``component`` names the component by a class of its own, also where ids are
    null or repeated (null for rows without words); ``digest`` is the MD5 of
    the text. They let callers choose rows of a component.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = scratch.save(sketch(docs, words, percent), "sketch")
    cells = _cells(sketched.where("size(keys) > 0"), scratch)
    points = sketched.where("vec is not null").join(cells.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("digest").alias("digest"), F.first("n").alias("n"), F.first("vec").alias("vec"))
    points = scratch.save(points, "points")
    rows = scratch.save(sketched.select("id", "n", "cls", "digest"), "rows")
    scratch.drop("sketch")
    texts = scratch.save(_texts(docs, points, scratch), "texts")
    labels = _linked(cells, points, texts, words, percent, scratch)
    scratch.drop("cells", "texts", "points", "bitmap")
    ids = rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("id"))
    named = ids.withColumn("label", F.col("cls")) if labels is None else ids.join(labels, "cls", "left").select("cls", "id", F.coalesce("label", "cls").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    classes = named.join(least, "label").select("cls", "component_id", F.col("label").alias("component"))
    rows = rows.withColumnRenamed("id", f"{OWN}id")
    linked = rows.where("n > 0").join(classes, "cls").select(f"{OWN}id", "n", "component_id", "component", "digest")
    alone = rows.where("n = 0").select(f"{OWN}id", "n", F.col(f"{OWN}id").alias("component_id"), F.lit(None).cast("long").alias("component"), "digest")
    return linked.union(alone).select(F.col(f"{OWN}id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "component", F.lower(F.hex("digest")).alias("digest"))
