"""A data source that reads large files as overlapping chunks: format("byte_chunks").

Each chunk is one input partition's row (image, start_b, bytes): files larger than a row
are read in parallel. Options: path (a file, a folder or a glob), chunk (bytes, 1 MiB), overlap
(bytes of the chunk before, 752, so that a pattern across a border is seen whole),
chunks_per_partition (16).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK, OVERLAP = 1 << 20, 752


def opened(path: str):
    """(file system, path in it) of a path or URI, as executors can open it."""
    from pyarrow import fs

    local = path.removeprefix("file:") if path.startswith("file:") or "://" not in path else None
    return (fs.LocalFileSystem(), "/" + local.lstrip("/")) if local is not None else fs.FileSystem.from_uri(path)


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ChunkReader(DataSourceReader):
    """Files must lie where every executor can open them (a shared mount); `pyarrow.fs` resolves the scheme."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.chunk = int(options.get("chunk", CHUNK))
        self.overlap = int(options.get("overlap", OVERLAP))
        self.span = self.chunk * int(options.get("chunks_per_partition", 16))

    def _open(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        return fs, system, path

    def partitions(self) -> list[Span]:
        fs, system, path = self._open()
        info = system.get_file_info(path)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file]
        return [Span(f.path, at, min(f.size, at + self.span)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.span)]

    def read(self, partition: Span) -> Iterator[tuple[str, int, bytes]]:
        _, system, _ = self._open()
        with system.open_input_file(partition.path) as f:
            for at in range(partition.start, partition.end, self.chunk):
                start = max(0, at - self.overlap)
                f.seek(start)
                yield partition.path, start, f.read(min(at + self.chunk, partition.end) - start)


class ByteChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_chunks"

    def schema(self) -> str:
        return "image string, start_b bigint, bytes binary"

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    spark.dataSource.register(ByteChunks)
    return spark.read.format("byte_chunks").options(path=path, chunk=str(chunk), overlap=str(overlap)).load()
