"""Byte-level BPE encoding and decoding with the tiktoken library.

Texts are cut at safe boundaries before encoding: places where a non-blank
character meets a blank one. No match of the splitting pattern spans such a
place, and what follows it does not depend on what went before, so the ids of
the pieces joined are the ids of the whole text. Memory is bounded by the
piece size and the text itself; a run without any such place stays whole.

Defined results: a null or empty text has no ids and decodes to no bytes;
special-token strings are ordinary text; other columns are left out of the
result, so their names cannot clash; repeated rows are encoded row by row; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN

PIECE = 1 << 16
_SAFE = re.compile(r"(?<=\S)(?=\s)")
_loaded: dict = {}


def load(path: str, pattern: str):
    """The encoding of a local rank file; kept per worker process."""
    if (path, pattern) not in _loaded:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cuts a text at the first safe boundary after each ``size`` characters."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row."""
    out = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = load(path, pattern)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for at in range(0, max(1, len(texts)), 256):  # small batches bound memory
                ids = [np.concatenate([own.encode_to_numpy(p, disallowed_special=()) for p in pieces(t.as_py() or "", piece)]).astype(np.int32) for t in texts[at : at + 256]]
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([names[at : at + 256], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], schema=out)

    source = docs.select(F.col(id_col).cast("long").alias(f"{OWN}id"), F.col(text_col).alias(f"{OWN}text"))
    return source.mapInArrow(run, "id bigint, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the raw bytes of the ids, whether valid UTF-8 or not."""
    out = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path, pattern)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                raw = pa.array([own.decode_bytes(x.values.to_numpy() if x.is_valid else []) for x in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(out.field("ids").type), raw], schema=out)

    source = encoded.select(F.col(id_col).cast("long").alias(f"{OWN}id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return source.mapInArrow(run, "id bigint, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sizes and SHA-256 digests of ids and decoded bytes."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
