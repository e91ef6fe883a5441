"""Token-id files: bit-plane shuffling of id blocks with a chunk index.

Texts are sorted by id over the cluster, encoded with the tokenizers library
and written in that order. A file holds blocks of ``BLOCK`` ids. A block is
transposed into planes (all lowest bytes, then the next ones, and so on; or the
same with bits), each plane is compressed on its own with zstandard, and a
plane of zeros takes no bytes. The end of the file holds the chunk index (place,
ids and plane sizes of every block) and the documents (id and length), so that
any range of ids is read from its blocks alone.

Layout, little-endian: ``MAGIC``; planes of all blocks; footer (zstandard:
per block uint64 offset, uint32 ids and uint32 size of each plane; per document
int64 id, uint8 that is 1 for a null id, uint64 length); a trailer with the sizes.

Files are written by tasks through ``pyarrow.fs``, so the folder may be any
store that it reaches. Each attempt of a task takes new names, and the manifest,
a Parquet table that Spark commits, names the files that count: what a lost
executor leaves behind is never read. A file ends at the first document
after ``file_ids`` ids, so tasks hold one block and one document at a time.

Defined results: null and empty texts have the end id only; rows are ordered by
id, null ids last, rows that share an id by a hash of the text; repeated rows
each have their place; strings of special tokens give the ids that the library
gives them; other columns are dropped, so their names cannot clash; long texts
are encoded piece by piece and come out whole; an empty table writes no file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"WHTOK01\n"
#: Ids of a block; ids after which a file ends with its document.
BLOCK, FILE_IDS = 1 << 16, 1 << 24
#: Pieces whose ids a worker keeps before it starts anew.
KNOWN_PIECES = 400_000
_TRAILER = struct.Struct("<QIIIIBB8s")  # footer offset, footer size, blocks, documents, CRC-32 of the footer, mode, planes, MAGIC
# Latin letters that lower to one letter, digits and common marks; the start of a special token's string is not among them.
_OTHER = r"[^\t-\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{20ac}]|<\|"
_LETTERS, _DIGITS = r"a-z\x{aa}\x{b5}\x{ba}\x{df}-\x{f6}\x{f8}-\x{24f}", r"0-9\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}"
_PIECE = rf"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+"
_encoders: dict = {}
_MANIFEST = "shard int, part int, file string, n_docs bigint, n_tokens bigint, n_bytes bigint"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte planes (4) or bit planes (32) of a block, lowest first."""
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bits:
        return [plane.tobytes() for plane in octets]
    return [np.packbits(octets[i // 8] >> (i % 8) & 1).tobytes() for i in range(32)]


def from_planes(planes: list[bytes | None], n: int, bits: bool) -> np.ndarray:
    """The ids of a block; a plane that is None is all zeros."""
    octets = np.zeros((4, n), np.uint8)
    for i, plane in enumerate(planes):
        if plane is None:
            continue
        raw = np.frombuffer(plane, np.uint8)
        if bits:
            octets[i // 8] |= np.unpackbits(raw, count=n) << (i % 8)
        else:
            octets[i] = raw
    return np.ascontiguousarray(octets.T).reshape(-1).view("<u4")


class FileWriter:
    """Writes one file of ids to an open binary stream."""

    def __init__(self, stream, bits: bool = False, block: int = BLOCK, level: int = 3):
        import zstandard

        self.pack, self.stream, self.bits, self.block = zstandard.ZstdCompressor(level=level).compress, stream, bits, block
        self.held, self.n_held, self.offset, self.n_tokens = [], 0, len(MAGIC), 0
        self.blocks, self.docs = [], []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.n_tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block * self.block
            for at in range(0, whole, self.block):
                self._write(flat[at : at + self.block])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray) -> None:
        packed = [self.pack(plane) if plane.count(0) < len(plane) else b"" for plane in to_planes(ids, self.bits)]
        self.blocks.append((self.offset, len(ids), [len(p) for p in packed]))
        self.stream.write(b"".join(packed))
        self.offset += sum(map(len, packed))

    def close(self) -> int:
        """Writes what is left and the footer; the size of the file."""
        if self.n_held:
            self._write(np.concatenate(self.held))
        planes = 32 if self.bits else 4
        ids = np.array([0 if d is None else d for d, _ in self.docs], "<i8")
        parts = [np.array([b[0] for b in self.blocks], "<u8"), np.array([b[1] for b in self.blocks], "<u4"), np.array([b[2] for b in self.blocks], "<u4"), ids, np.array([d is None for d, _ in self.docs], np.uint8), np.array([n for _, n in self.docs], "<u8")]
        footer = self.pack(b"".join(p.tobytes() for p in parts))
        self.stream.write(footer + _TRAILER.pack(self.offset, len(footer), len(self.blocks), len(self.docs), zlib.crc32(footer), self.bits, planes, MAGIC))
        return self.offset + len(footer) + _TRAILER.size


class FileReader:
    """Random access to a file of ids: ``doc_ids`` (None: null), ``lengths`` and ``read``."""

    def __init__(self, stream):
        import zstandard

        unpack = self.unpack = zstandard.ZstdDecompressor().decompress
        self.stream = stream
        size = stream.seek(0, 2)
        stream.seek(max(0, size - _TRAILER.size))
        tail = stream.read(_TRAILER.size)
        if len(tail) < _TRAILER.size or not tail.endswith(MAGIC):
            raise ValueError("not a whole file of token ids")
        offset, length, blocks, docs, crc, bits, planes, _ = _TRAILER.unpack(tail)
        stream.seek(offset)
        footer = stream.read(length)
        if zlib.crc32(footer) != crc:
            raise ValueError("the chunk index is damaged")
        raw, at, self.bits = unpack(footer), 0, bool(bits)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, kind, n, at)
            at += found.nbytes
            return found

        self.offsets, counts, self.sizes = take("<u8", blocks), take("<u4", blocks), take("<u4", blocks * planes).reshape(blocks, planes)
        ids, null, self.lengths = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, null, strict=True)]
        self.starts, self.ends = np.r_[0, np.cumsum(self.lengths)], np.cumsum(counts, dtype=np.int64)
        self._last = (-1, np.empty(0, np.uint32))

    def _block(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            self.stream.seek(int(self.offsets[k]))
            raw, at, planes = self.stream.read(int(self.sizes[k].sum())), 0, []
            for size in map(int, self.sizes[k]):
                planes.append(self.unpack(raw[at : at + size]) if size else None)
                at += size
            self._last = (k, from_planes(planes, int(self.ends[k] - (self.ends[k - 1] if k else 0)), self.bits))
        return self._last[1]

    def read(self, start: int, n: int) -> np.ndarray:
        """n ids from ``start``, from the blocks that hold them."""
        found, k = [np.empty(0, "<u4")], int(np.searchsorted(self.ends, start, side="right"))
        while n > 0 and k < len(self.ends):
            first = int(self.ends[k - 1]) if k else 0
            part = self._block(k)[start - first : start - first + n]
            found.append(part)
            start, n, k = start + len(part), n - len(part), k + 1
        return np.concatenate(found)


class _Table(dict):
    """Numbers strings by their first sight; ``new`` holds those without ids so far."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        return self.setdefault(piece, len(self))


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, which encodes each distinct piece once.

    The library splits texts into pieces (stretches of letters, single digits,
    stretches of marks, contractions) that no merge crosses. Texts in Latin
    letters are lowered and split here in the same way, by Arrow; all others are
    split at white space only. Each new piece goes through the library; a table
    keeps its ids. This holds for tokenizers that drop white space and lower
    their texts, and is checked on the loaded one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self._clear()
        for probe in ("Ab 12,\tc's\n d\u00c9\u00df.", "it's 3\u00bd \u2013 we'll"):
            if self.encode(pa.array([probe]), 1)[0].tolist() != [*self.own.encode(probe, add_special_tokens=False).ids, 1]:
                raise ValueError("this tokenizer does not encode piece by piece")

    def _clear(self) -> None:
        self.known = _Table()
        self.flat, self.n_flat, self.n_sizes = np.empty(1 << 16, np.uint32), 0, 0
        self.starts, self.sizes = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Appends the ids of the next pieces of the table."""
        first, n = self.n_sizes, len(sizes)
        for name, used, more in (("flat", self.n_flat, len(ids)), ("starts", first, n), ("sizes", first, n)):
            held = getattr(self, name)
            if used + more > len(held):
                setattr(self, name, np.concatenate([held[:used], np.empty(used + 2 * more, held.dtype)]))
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.starts[first : first + n] = self.n_flat + np.cumsum(sizes) - sizes
        self.sizes[first : first + n] = sizes
        self.n_flat, self.n_sizes = self.n_flat + len(ids), first + n

    def _numbers(self, pieces: list[str], mark: str) -> np.ndarray:
        """Places of pieces in the table; new ones are encoded. ``mark`` keeps words of other scripts apart."""
        at = np.fromiter(map(self.known.__getitem__, (p + mark for p in pieces) if mark else pieces), np.int64, len(pieces))
        new, self.known.new = self.known.new, []
        # The library writes bytes as characters; those of ASCII pieces stand for themselves.
        plain = [not mark and p.isascii() for p in new]
        tokenize, ids = self.own.model.tokenize, [None] * len(new)
        for k, p in enumerate(new):
            if plain[k]:
                ids[k] = [t.id for t in tokenize(p)]
            elif mark:
                ids[k] = self.own.encode(p, add_special_tokens=False).ids
        rest = [k for k, x in enumerate(ids) if x is None]
        for at_once in (rest[i : i + 4096] for i in range(0, len(rest), 4096)):
            made = self.own.encode("\n".join([new[k] for k in at_once]), add_special_tokens=False)
            cuts = np.searchsorted(made.word_ids, np.arange(len(at_once) + 1)).tolist()
            held = made.ids
            for k, i, j in zip(at_once, cuts, cuts[1:], strict=False):
                ids[k] = held[i:j]
        self._add(np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
        return at

    def _split(self, texts: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray]:
        """Table places of all pieces of the texts, and where each text ends among them."""
        if not mark:
            texts = pc.replace_substring_regex(pc.utf8_lower(texts), _PIECE, r"\0 ")
        listed = pc.ascii_split_whitespace(texts)
        coded = listed.flatten().dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_pylist(), mark)
        return numbers[coded.indices.to_numpy(zero_copy_only=False)], np.cumsum(pc.list_value_length(listed).to_numpy(zero_copy_only=False))

    def encode(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """Ids of each text, ``end_id`` last; null texts are empty."""
        if len(self.known) > KNOWN_PIECES:
            self._clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        other = pc.match_substring_regex(texts, _OTHER)
        found: list = [None] * len(texts)
        for mark, chosen in (("", pc.invert(other)), (" ", other)):
            places = np.flatnonzero(chosen.to_numpy(zero_copy_only=False))
            if not len(places):
                continue
            at, ends = self._split(texts.filter(chosen), mark)
            size = self.sizes[at]
            stop = np.cumsum(size)
            ids = self.flat[np.repeat(self.starts[at] - stop + size, size) + np.arange(int(size.sum()))]
            cuts = np.r_[0, stop][ends]
            for place, a, b in zip(places, np.r_[0, cuts[:-1]], cuts, strict=True):
                found[place] = np.append(ids[a:b], np.uint32(end_id))
        return found


def encoder(path: str) -> PieceEncoder:
    """The encoder of a local file; kept per worker process."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def open_folder(uri: str):
    """(file system, path) of a folder's URI or absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", bits: bool = False, block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of all texts, each followed by ``end_id``, in the order of their ids.

    Returns the manifest: ``shard`` and ``part`` order the files; ``start`` is
    the number of ids in all files before.
    """
    out = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, part, own = TaskContext.get().partitionId(), None, 0, encoder(tokenizer)
        store, root = open_folder(folder)

        def end() -> pa.RecordBatch:
            size = writer.close()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((shard, part, name, len(writer.docs), writer.n_tokens, size), out, strict=True)], schema=out)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                for doc_id, ids in zip(rows.column(0).to_pylist(), own.encode(rows.column(1), end_id), strict=True):
                    if writer is None:
                        name = f"ids-{shard:06d}-{part:04d}-{uuid.uuid4().hex}.tok"
                        stream = store.open_output_stream(f"{root}/{name}")
                        writer = FileWriter(stream, bits, block)
                    writer.add(doc_id, ids)
                    if writer.n_tokens >= file_ids:
                        yield end()
                        writer, part = None, part + 1
        if writer is not None:
            yield end()

    store, root = open_folder(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text").asc()]
    # The last key only spreads equal rows over ranges.
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("row").asc())
    manifest = ranged.sortWithinPartitions(*order).select("id", "text").mapInArrow(run, _MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return read_manifest(docs.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One small row per file, with the number of ids in all files before."""
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``start`` and ``ids`` (little-endian unsigned 32-bit integers).

    Files are dealt to tasks one by one and read block by block.
    """
    out = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as stream:
                    file, rows, held = FileReader(stream), [], 0
                    for doc_id, at, n in zip(file.doc_ids, map(int, file.starts), map(int, file.lengths), strict=False):
                        rows.append((doc_id, first + at, file.read(at, n).tobytes()))
                        held += n
                        if held > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    files = read_manifest(spark, folder).select("file", "start")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks).mapInArrow(run, "id bigint, start bigint, ids binary").withColumnRenamed("id", id_col)


def read_ids(spark: SparkSession, folder: str, start: int, n: int) -> np.ndarray:
    """``n`` ids from place ``start`` of the whole sequence: only the blocks that hold them are read."""
    store, root = open_folder(folder)
    held = read_manifest(spark, folder).where((F.col("start") < start + n) & (F.col("start") + F.col("n_tokens") > start)).orderBy("start")
    found = [np.empty(0, "<u4")]
    for row in held.select("file", "start", "n_tokens").toLocalIterator():
        with store.open_input_file(f"{root}/{row.file}") as stream:
            at = max(0, start - row.start)
            found.append(FileReader(stream).read(at, min(row.n_tokens, start + n - row.start) - at))
    return np.concatenate(found)


def document_sums(read: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Length and CRC-32 of the ids of every document."""
    return read.select(id_col, "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
