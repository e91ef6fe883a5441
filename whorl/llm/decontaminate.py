"""Benchmark decontamination by CGK embedding, bit-sampling LSH and verification.

Words of texts become ids of the benchmark's vocabulary (others share one id).
A CGK random walk reads a window: at step j it emits the current word and moves
on by one random bit of (j, word), so windows at small edit distance tend to
emit words that agree in most places. All starts of a document walk together:
``at = at + bit(j, word[at])`` over arrays. Each repetition uses fresh bits and
samples ``places`` steps of the walk within twice the item's size; windows and
items with equal samples are candidates. The number of repetitions follows from
the target recall and the agreement expected at the edit limit. Candidates are
verified exactly: the item's least edit distance to any stretch of the
neighbourhood must be at most ``percent`` of its words.

A start is walked only if the item-sized window holds enough vocabulary words
and word pairs of the benchmark: each other word costs an edit, and an edit
takes at most two pairs away, so this loses nothing.

The benchmark is broadcast in blocks of ``BLOCK_ITEMS`` items of at most
``BLOCK_WORDS`` words, each block being one pass over the documents. A pass is
written before the next block is read and its broadcast released, so the driver
and each task hold one block; documents are never collected.

Defined results: null and blank texts or items match nothing; items too short
for an edit (under five words at 20 %) are compared exactly, as a run of equal
words; repeated rows are tested row by row; other columns are dropped; texts of
any length are searched whole; an empty benchmark leaves every document clean
and an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows
from .shingles import mix, word_hashes

#: Word edits allowed, as a percentage of the item's words.
PERCENT = 20
PLACES = 3
RECALL = 0.999
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
CHUNK = 1 << 15
#: Bytes of text that are searched together.
TOGETHER = 16 << 20
_U = np.uint64


def edits(size: int, percent: int) -> int:
    return percent * size // 100


def repetitions(percent: int, places: int, recall: float) -> int:
    """Repetitions for which an item at the edit limit is missed at most 1 - recall of the time.

    An edit puts the walks of a pair out of step for about two steps before
    they meet again, so at ``percent`` % edits about 2 * percent % of the
    places differ in a repetition (measured in the tests).
    """
    hit = max(0.05, 1 - 2 * percent / 100) ** places
    return math.ceil(math.log(1 - recall) / math.log(1 - hit))


class Benchmark:
    """Items of one block, with their signatures for every repetition."""

    def __init__(self, items: list[tuple[int, bytes]], percent: int, places: int, recall: float, seed: int = 7):
        texts = [(i, word_hashes(t or b"")) for i, t in items]
        texts = [(i, w) for i, w in texts if len(w)]
        self.ids = np.array([i for i, _ in texts], np.int64)
        self.vocabulary = np.unique(np.concatenate([w for _, w in texts])) if texts else np.empty(0, _U)
        self.words = [self.encode(w) for _, w in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.couples = np.unique(np.concatenate([self.couple(w) for w in self.words])) if texts else np.empty(0, np.int64)
        self.percent, self.places = percent, places
        self.reps = repetitions(percent, places, recall)
        draw = np.random.default_rng(seed)
        self.salts = draw.integers(1, 1 << 40, self.reps)
        self.picks = {int(n): np.sort(draw.integers(0, max(1, 2 * n - 2), (self.reps, places)), axis=1) for n in np.unique(self.sizes)}
        self.tables: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(self.reps)]
        for n in self.picks:
            own = np.flatnonzero(self.sizes == n)
            flat = np.concatenate([np.concatenate([self.words[i], np.zeros(n, np.int64)]) for i in own])
            starts = np.arange(len(own)) * 2 * n
            for r in range(self.reps):
                key = self.signatures(flat, starts, r, [n])[n]
                order = np.argsort(key, kind="stable")
                self.tables[r][n] = (key[order], own[order])

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """1-based vocabulary ids; 0 for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes).clip(0, len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def couple(self, words: np.ndarray) -> np.ndarray:
        return words[:-1] * (len(self.vocabulary) + 1) + words[1:]

    def signatures(self, words: np.ndarray, starts: np.ndarray, rep: int, sizes: list[int]) -> dict[int, np.ndarray]:
        """Sampled embeddings of the windows at ``starts``, for each size."""
        own = mix(np.arange(len(self.vocabulary) + 1).astype(_U), int(self.salts[rep]))
        steps = int(max(self.picks[n][rep].max() for n in sizes)) + 1
        bits = own
        at, out = starts.copy(), {n: np.zeros(len(starts), _U) for n in sizes}
        due: dict[int, list[tuple[int, int]]] = {}
        for n in sizes:
            for place in self.picks[n][rep]:
                due.setdefault(int(place), []).append(n)
        for j in range(steps):
            if j % 64 == 0:
                bits = mix(own, 1000 + j)
            now = words[np.minimum(at, len(words) - 1)]
            for n in due.get(j, ()):
                inside = at - starts < n
                out[n] = mix(out[n] * _U(31) + np.where(inside, own[now], _U(0)))
            at = at + ((bits[now] >> _U(j % 64)) & _U(1)).astype(np.int64)
        return out

    def distances(self, items: np.ndarray, stretches: np.ndarray) -> np.ndarray:
        """Least edits that turn each item into any part of its stretch; items of one size."""
        patterns = np.stack([self.words[i] for i in items])
        steps = np.arange(patterns.shape[1] + 1)
        row = np.broadcast_to(steps, (len(items), len(steps)))
        best = row[:, -1]
        for w in stretches.T:
            new = np.zeros(row.shape, np.int64)
            new[:, 1:] = np.minimum(row[:, :-1] + (patterns != w[:, None]), row[:, 1:] + 1)
            row = np.minimum.accumulate(new - steps, axis=1) + steps
            best = np.minimum(best, row[:, -1])
        return best

    def search(self, hashes: list[np.ndarray]) -> list[dict[int, int]]:
        """For each text, given as word hashes: least edits of every item found, by item position."""
        found: list[dict[int, int]] = [{} for _ in hashes]
        lengths = np.array([len(h) for h in hashes], np.int64)
        if not self.words or not lengths.sum():
            return found
        # All texts in one array; the zeros between them keep windows apart.
        gap = int(self.sizes.max())
        begins = np.concatenate([[0], np.cumsum(lengths + gap)[:-1]])
        words = np.zeros(int((lengths + gap).sum()), np.int64)
        for at, h in zip(begins, hashes, strict=True):
            words[at : at + len(h)] = self.encode(h)
        pair = np.zeros(len(words), bool)
        both = np.flatnonzero((words[:-1] > 0) & (words[1:] > 0))
        if len(self.couples):
            key = words[both] * (len(self.vocabulary) + 1) + words[both + 1]
            pair[both] = self.couples[np.searchsorted(self.couples, key).clip(0, len(self.couples) - 1)] == key
        pairs, known = (np.concatenate([[0], np.cumsum(x)]) for x in (pair, words > 0))
        end = len(words)
        # Starts from which some stretch of the shortest item's size is dense enough for any item.
        dense = np.arange(end)
        if (short := min(self.picks) - 1) > 0:
            least = min(-(-self._pairs_needed(n) // -(-(n - 1) // short)) for n in self.picks)
            full = np.flatnonzero(pairs[np.minimum(dense + short, end)] - pairs[:-1] >= least)
            near = np.zeros(end + 1, np.int64)
            np.add.at(near, np.maximum(full - gap, 0), 1)
            np.add.at(near, np.minimum(full + 1, end), -1)
            dense = np.flatnonzero(np.cumsum(near)[:end])
        masks = {}
        for n in self.picks:
            own = known[np.minimum(dense + n, end)] - known[dense]
            couples = pairs[np.minimum(dense + n - 1, end)] - pairs[dense]
            good = (own >= n - edits(n, self.percent)) & (couples >= self._pairs_needed(n))
            if good.any():
                masks[n] = dense[good]
        candidates: set[tuple[int, int]] = set()
        starts = np.unique(np.concatenate(list(masks.values()))) if masks else np.empty(0, np.int64)
        for low in range(0, len(starts), CHUNK):
            own = starts[low : low + CHUNK]
            ask = {n: inside for n, m in masks.items() if (inside := np.isin(own, m, assume_unique=True)).any()}
            for r in range(self.reps):
                for n, key in self.signatures(words, own, r, list(ask)).items():
                    keys, items = self.tables[r][n]
                    left = np.searchsorted(keys, key)
                    for i in np.flatnonzero((keys[left.clip(0, len(keys) - 1)] == key) & ask[n]):
                        at = left[i]
                        while at < len(keys) and keys[at] == key[i]:
                            candidates.add((int(own[i]), int(items[at])))
                            at += 1
        if not candidates:
            return found
        tried = np.array(sorted(candidates), np.int64)
        texts = np.searchsorted(begins, tried[:, 0], side="right") - 1
        for n in np.unique(self.sizes[tried[:, 1]]):
            limit = edits(int(n), self.percent)
            for rows in np.array_split(r := np.flatnonzero(self.sizes[tried[:, 1]] == n), -(-len(r) // 4096)):
                at = tried[rows, 0][:, None] + np.arange(-limit, n + limit)
                low = begins[texts[rows]][:, None]
                inside = (at >= low) & (at < low + lengths[texts[rows]][:, None])
                now = self.distances(tried[rows, 1], np.where(inside, words[at.clip(0, end - 1)], -1))
                for text, item, e in zip(texts[rows], tried[rows, 1], now, strict=True):
                    if e <= limit:
                        own = found[text]
                        own[int(item)] = min(int(e), own.get(int(item), int(e)))
        return found

    def _pairs_needed(self, n: int) -> int:
        return max(0, n - 1 - 2 * edits(int(n), self.percent))


def _passes(docs: DataFrame, benchmark: DataFrame, make, one) -> DataFrame:
    """``docs`` after a pass with each block: ``one(docs, held)`` plans it, ``make`` builds what is held."""
    scratch, held, turn = None, None, 0
    for block in _blocks(benchmark):
        if held is not None:
            scratch = scratch or Scratch(docs.sparkSession, "benchmark")
            docs = scratch.save(docs, str(turn))
            scratch.drop(str(turn - 1))
            held.destroy()
            turn += 1
        held = docs.sparkSession.sparkContext.broadcast(make(block))
        docs = one(docs, held)
    return docs


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        block.append((row[0], bytes(row[1])))
        size += len(row[1]) // 4
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _leaks(own: Benchmark, texts) -> Iterator[list[dict]]:
    """Found items of each text (an Arrow array of bytes), searched in bounded parts."""
    part, size = [], 0
    for text in [*texts, None]:
        if text is not None:
            raw = text.as_py() or b""
            part.append(word_hashes(raw))
            size += len(raw)
        if text is None or size >= TOGETHER:
            for got in own.search(part):
                yield sorted(({"item": int(own.ids[i]), "edits": e} for i, e in got.items()), key=lambda x: (x["item"], x["edits"]))
            part, size = [], 0


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long"), F.col(item_text_col).cast("binary"))
    return items.orderBy(*items.columns)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT, places: int = PLACES, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` without any benchmark item, with their columns."""
    at = docs.columns.index(text_col)

    def one(docs: DataFrame, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not x for x in _leaks(held.value, batch.column(at).cast(pa.binary()))], pa.bool_()))

        return map_rows(docs, run)

    return _passes(docs, _items(benchmark, item_col, item_text_col), lambda block: Benchmark(block, percent, places, recall), one)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT, places: int = PLACES, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: id, ``item_ids`` (sorted), ``edits`` of each, ``leaked``."""
    kind = "array<struct<item:bigint,edits:int>>"
    out = pa.schema([("id", pa.int64()), ("text", pa.binary()), ("found", pa.list_(pa.struct([("item", pa.int64()), ("edits", pa.int32())])))])
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.array().cast(kind).alias("found"))

    def one(found: DataFrame, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # A pass adds its block's items to the row; ids play no part.
                rows = [sorted(old + new, key=lambda x: (x["item"], x["edits"])) for old, new in zip(batch.column(2).to_pylist(), _leaks(held.value, batch.column(1)), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, out.field("found").type)], schema=out)

        return found.mapInArrow(run, f"id bigint, text binary, found {kind}")

    found = _passes(found, _items(benchmark, item_col, item_text_col), lambda block: Benchmark(block, percent, places, recall), one)
    return found.select(F.col("id").alias(id_col), F.transform("found", lambda x: x["item"]).alias("item_ids"), F.transform("found", lambda x: x["edits"]).alias("edits"), (F.size("found") > 0).alias("leaked"))
