"""``spark.read.format("nist")``: one row per record of transaction files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import RECORDS


#: Bytes after which a partition of small files ends.
PARTITION_BYTES = 32 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _system(self):
        from pyarrow import fs

        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[Files]:
        """Files in the order of their paths, dealt into parts of about ``PARTITION_BYTES``."""
        from pyarrow import fs

        system, root = self._system()
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File]
        parts, held, size = [], [], 0
        for i in sorted(found, key=lambda i: i.path):
            held.append(i.path)
            size += i.size
            if size >= PARTITION_BYTES:
                parts, held, size = [*parts, Files(held)], [], 0
        return [*parts, Files(held)] if held else parts

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self._records(path)

    def _records(self, path: str) -> Iterator[tuple]:
        from ..operators.transactions import frames

        system, _ = self._system()
        with system.open_input_stream(path) as source:
            content = source.read()
        if not content:
            yield path, None, None, None, None, None, None, None
        for i, r in enumerate(frames(content)):
            import re

            body = r["data"][:-1].decode("latin-1") if r["fielded"] else None
            pieces = re.split(r"\x1d(?=[0-9]+\.[0-9]{3}:)", body) if body is not None else []
            yield path, i, r["type"], r["byte_offset"], r["size"], pieces, r["error"], None if r["fielded"] else r["data"]


class NistSource(DataSource):
    """Register with ``spark.dataSource.register(NistSource)``; option ``path``: a file or folder."""

    @classmethod
    def name(cls) -> str:
        return "nist"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))
